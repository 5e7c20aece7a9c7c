"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 16 bytes cuts a text where its upper bits are zero, moved on to the next single space
between two visible ASCII characters, so equal passages of different documents fall into equal chunks. A chunk is encoded
once and its ids are kept, within a memory bound, for all further documents of the worker. Each join of two chunks is
checked by re-encoding the pieces at both of its sides as one string; where that disagrees, one more piece at each side is
taken until the ids agree.

A chunk is encoded by a compiled byte-pair core that is built from the tokenizer file, where that file describes plain
byte-level BPE; chunks with a special token's string, very long chunks and all other tokenizers go through the
tokenizers library itself.

Chunks are reused within an executor's Python worker, not across the cluster: dealing out all chunks and their ids by
content would move about twice the corpus.

Defined cases: null text counts as empty; empty text has no ids and decodes to the empty text; a run without spaces is
one chunk, however long, as is a text of spaces; strings of special tokens in a text become special ids, as the library
does by default; repeated rows repeat; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from sys import byteorder

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import kernel, slices

CHUNK_BITS = 10
#: Longer chunks, in characters, go through the library.
LONG_CHUNK = 1 << 16
#: Fixed values of the rolling hash: a multiplicative sequence, one for each byte.
GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
VISIBLE = np.zeros(256, bool)
VISIBLE[0x21:0x7F] = True
#: Fixed value: the pattern by which byte-level pre-tokenizers split a text.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def cuts(data: bytes, bits: int = CHUNK_BITS) -> list[int]:
    """Positions of spaces at which chunks begin."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < 64:
        return []
    h = GEAR[b]
    for step in (1, 2, 4, 8):  # h covers 2, 4, 8, 16 bytes
        nxt = h.copy()
        nxt[step:] += h[:-step] << np.uint32(step)
        h = nxt
    hits = np.flatnonzero((h >> np.uint32(32 - bits)) == 0)
    space = np.flatnonzero((b[1:-1] == 0x20) & VISIBLE[b[:-2]] & VISIBLE[b[2:]]) + 1
    if not len(hits) or not len(space):
        return []
    at = np.searchsorted(space, hits)
    return np.unique(space[at[at < len(space)]]).tolist()


def alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for the 256 bytes."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in set(visible)]
    return {chr(x): x for x in visible} | {chr(256 + k): x for k, x in enumerate(rest)}


def byte_core(spec: dict):
    """The compiled core of a plain byte-level BPE, or None if the file asks for anything else.

    Merging the pair whose union has the smallest id is the file's own order only if merge k makes id 256 + k."""
    model, pre = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or not level or spec.get("normalizer") or any(t.get(k) for t in spec.get("added_tokens") or () for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return None
    letters, vocab = alphabet(), model["vocab"]
    added = {t["content"] for t in spec.get("added_tokens") or ()}
    ranks = {bytes(map(letters.__getitem__, t)): k for t, k in vocab.items() if t not in added}
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if made != list(range(256, 256 + len(made))) or len(ranks) != 256 + len(made):
        return None
    import tiktoken

    return tiktoken.Encoding("chunks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})._core_bpe


class ChunkEncoder:
    """encode(texts) -> ids as little-endian unsigned 32-bit bytes, equal to the library's for whole texts."""

    def __init__(self, path: str, chunk_room: int = 12 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.core = byte_core(spec)
        added = [re.escape(t["content"]) for t in spec.get("added_tokens") or ()]
        self.special = re.compile("|".join(added) or r"(?!)")
        self.chunk_room = chunk_room
        self.chunks: dict[bytes, bytes] = {}
        self.held = 0
        self.joins: set[tuple[bytes, bytes]] = set()
        self.stats = {"chunks": 0, "reused": 0, "joins": 0, "repaired": 0}
        self._bytes: list[bytes] | None = None

    def library(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in done] if byteorder == "little" else [np.array(e.ids, "<u4").tobytes() for e in done]

    def plain(self, texts: list[str]) -> list[bytes]:
        if self.core is None:
            return self.library(texts)
        one, special = self.core.encode_ordinary, self.special.search
        odd = [k for k, t in enumerate(texts) if len(t) > LONG_CHUNK or special(t)]
        known = dict(zip(odd, self.library([texts[k] for k in odd])))
        ids = lambda x: array("I", x).tobytes() if byteorder == "little" else np.array(x, "<u4").tobytes()
        return [known[k] if k in known else ids(one(t)) for k, t in enumerate(texts)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = []
        for t in texts:
            data = (t or "").encode("utf-8", "replace")
            ends = [*cuts(data), len(data)]
            cut.append([data[a:b] for a, b in zip([0, *ends], ends)] if data else [])
        wanted = dict.fromkeys(c for parts in cut for c in parts)
        fresh = [c for c in wanted if c not in self.chunks]
        self.stats["chunks"] += sum(map(len, cut))
        self.stats["reused"] += sum(map(len, cut)) - len(fresh)
        done = dict(zip(fresh, self.plain([c.decode() for c in fresh])))
        known = {c: self.chunks[c] if c in self.chunks else done[c] for c in wanted}
        wrong = self.disagreeing(cut)
        out = [self.joined(parts, known, wrong) for parts in cut]
        size = sum(len(c) + len(i) + 200 for c, i in done.items())
        if self.held + size > self.chunk_room:
            self.chunks.clear()
            self.held = 0
        if size <= self.chunk_room:
            self.chunks.update(done)
            self.held += size
        return out

    @staticmethod
    def sides(left: bytes, right: bytes, k: int = 1) -> tuple[bytes, bytes]:
        """The last k pieces of left and the first k of right."""
        a, b = len(left), 0
        for _ in range(k):
            a = max(0, left.rfind(b" ", 0, a)) if a > 0 else 0
            b = x if b < len(right) and (x := right.find(b" ", b + 1)) > 0 else len(right)
        return left[a:], right[:b]

    def disagreeing(self, cut: list[list[bytes]]) -> set[tuple[bytes, bytes]]:
        """Joins whose two sides, encoded as one string, have other ids than encoded apart."""
        asked = list({s for parts in cut for s in map(self.sides, parts, parts[1:])} - self.joins)
        self.stats["joins"] += len(asked)
        whole, left, right = (self.plain(x) for x in ([(a + b).decode() for a, b in asked], [a.decode() for a, _ in asked], [b.decode() for _, b in asked]))
        wrong = {s for s, w, a, b in zip(asked, whole, left, right) if w != a + b}
        if len(self.joins) > 50_000:
            self.joins.clear()
        self.joins.update(s for s in asked if s not in wrong and len(s[0]) + len(s[1]) < 128)
        return wrong

    def joined(self, parts: list[bytes], known: dict[bytes, bytes], wrong: set) -> bytes:
        if not wrong or not any(self.sides(a, b) in wrong for a, b in zip(parts, parts[1:])):
            return b"".join(map(known.__getitem__, parts))
        text, ids = parts[0], known[parts[0]]
        for part in parts[1:]:
            joint = self.sides(text, part) in wrong
            ids = self.repaired(text, ids, part, known[part]) if joint else ids + known[part]
            text += part
        return ids

    def repaired(self, text: bytes, ids: bytes, part: bytes, part_ids: bytes) -> bytes:
        """The ids of text + part. The re-encoded middle grows until a wider one confirms it."""
        self.stats["repaired"] += 1
        one = lambda x: self.plain([x.decode()])[0]
        k = 1
        while True:
            left, right = self.sides(text, part, k)
            wide_left, wide_right = self.sides(text, part, k + 1)
            if (wide_left, wide_right) == (left, right):
                return one(text + part)
            middle, tail, head = one(left + right), one(left), one(right)
            around = one(wide_left[: len(wide_left) - len(left)]), one(wide_right[len(right) :])
            if one(wide_left + wide_right) == around[0] + middle + around[1] and ids.endswith(tail) and part_ids.startswith(head):
                return ids[: len(ids) - len(tail)] + middle + part_ids[len(head) :]
            k *= 2

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id, by the byte alphabet."""
        if self._bytes is None:
            letters, vocab = alphabet(), self.tokenizer.get_vocab()
            table = [b""] * (max(vocab.values(), default=-1) + 1)
            for token, k in vocab.items():
                table[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
            self._bytes = table
        return self._bytes

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token_bytes().__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the ids: one row for each input row."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches):
        encoder = ChunkEncoder(tokenizer_path)
        for b in slices(batches, 64):
            ids = encoder.encode(b.column(1).to_pylist())
            cols = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in ids], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols.append(pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return kernel(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, schema)
