"""The pipeline's stages, each on what its predecessor kept, against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from voxelweave.llm import bpe, jaccard, langid, simhash
from voxelweave.llm.common import materialise

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(11)
    sounds = {"aa": ["ka", "lo", "mi", "ru"], "bb": ["sch", "tz", "ung", "er"]}
    rows = []
    for i in range(160):
        lang = rng.choice(sorted(sounds))
        words = ["".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(60, 120))]
        rows.append([i, " ".join(words), lang, rng.choice(["x", "y", "z", None])])
    for i in range(160, 190):  # exact copies with other white space, then near copies
        text = rows[i % 20][1]
        rows.append([i, text.replace(" ", "  ", 3) if i % 2 else text, "aa", "x"])
    for i in range(190, 200):
        words = (rows[40 + i % 10][1] + " " + rows[60 + i % 10][1]).split() * 4
        rows.append([i, " ".join(words), "aa", "y"])
        words[7] = "kaka"
        rows.append([i + 100, " ".join(words), "aa", "y"])
    rows += [[400, None, "aa", "x"], [401, "12 34 !!", "aa", "x"], [402, "", None, None]]
    return [(*r, len(r[1] or "")) for r in rows]


def test_stages(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, ""), name)
        kept[name] = (before.collect(), docs.collect())
        if name != "bpe":
            assert docs.columns == NAMES

    rows, out = kept["language_id"]
    assert {r["doc_id"] for r in rows} - {r["doc_id"] for r in out} == {400, 401, 402}

    rows, out = kept["exact_dedup"]
    groups = {}
    for r in rows:
        groups.setdefault("".join(r["text"].split(" ")), []).append((-len(r["text"]), r["doc_id"]))
    assert {r["doc_id"] for r in out} == {min(g)[1] for g in groups.values()}

    rows, out = kept["near_dedup"]
    fps = {r["doc_id"]: np.uint64(simhash.majority(simhash.shingle_hashes(r["text"], 5)) & (2**64 - 1)) for r in rows}
    label = {d: d for d in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if int(fps[a] ^ fps[b]).bit_count() <= 7 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    assert {r["doc_id"] for r in out} == set(label.values())
    assert len(out) == len(rows) - 10

    rows, out = kept["mixing"]
    times = Counter(r["doc_id"] for r in out)
    assert set(times.values()) <= {1, 2}
    words = sum(len(r["text"].split()) for r in rows)
    assert sum(len(r["text"].split()) for r in out) == pytest.approx(1.5 * words, rel=0.08)

    rows, out = kept["bpe"]
    library = bpe.ChunkEncoder(path)
    want = Counter((r["doc_id"], hashlib.sha256(library.plain([r["text"]])[0]).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()) for r in rows)
    assert Counter((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in out) == want
    assert all(len(r["ids"]) == r["n_tokens"] for r in out)


def test_language_stage_agrees_with_operator(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.fit(docs)
    told = {r["doc_id"] for r in langid.predict(docs, model).collect() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    assert {r["doc_id"] for r in langid.keep_identified(docs, model).collect()} == told


@pytest.mark.parametrize("small, block", [(32, 2048), (2, 3)])
def test_near_copies_are_those_at_08(spark, small, block):
    """Pairs just over and under 0.8, which differ in about ten bits of their fingerprints, against all pairs."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(25):
        words = [word() for _ in range(rng.randint(40, 300))]
        texts.append(" ".join(words))
        for _ in range(6):
            near = list(words)
            for at in rng.sample(range(len(near)), max(1, round(len(near) * rng.uniform(0.005, 0.05)))):
                near[at] = word()
            texts.append(" ".join(near))
    texts += [None, "", "a b", "A  b", "a b c", None]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(None, texts[0])]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    label = list(range(len(texts)))
    similar = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in similar:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_copies(df, small=small, block=block).collect() if r["doc_id"] is not None}
    assert got == dict(enumerate(label))
    kept = {r["doc_id"] for r in simhash.drop_near_copies(df).collect()}
    assert kept == set(label) | {None}


def test_sets_are_the_same_by_bits_and_by_shuffle(spark):
    rows = [(r[0], r[1]) for r in corpus()[:120]] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = jaccard.prints(df, "doc_id", "text", 5)
    nodes = prints.where("doc_id % 3 = 0").select("node", "th").dropDuplicates(["node"])
    got = [{r["node"]: bytes(r["found"]) for r in jaccard.sets_of(df, nodes, "text", 5, most).collect()} for most in (1 << 26, 1)]
    assert got[0] == got[1] and len(got[0]) == nodes.count()
    assert all(jaccard.node_of(np.frombuffer(x, np.uint64)) == k for k, x in got[0].items())


def test_near_stage_links_by_simhash(spark, monkeypatch):
    """Pairs within the fingerprints' bits are proposed by SimHash; the stage links those at 0.8 and asks the groups of
    shared shingles only for the rest."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for k in range(40):
        words = [word() for _ in range(rng.randint(100, 300))]
        near = list(words)
        for at in rng.sample(range(len(near)), 1 + k % 4):
            near[at] = word()
        texts += [" ".join(words), " ".join(near)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [simhash.shingle_hashes(t, 5) for t in texts]
    fps = [simhash.majority(simhash.shingle_hashes(t, 3)) & (2**64 - 1) for t in texts]
    want = {(a, b) for b in range(len(texts)) for a in range(b) if (fps[a] ^ fps[b]).bit_count() <= 7 and jaccard.similar(np.unique(sets[a]), np.unique(sets[b]))}
    alike = {(a, a + 1) for a in range(0, len(texts), 2) if jaccard.similar(np.unique(sets[a]), np.unique(sets[a + 1]))}
    assert 10 < len(want) and want < alike
    asked = {}
    real = jaccard.similar_pairs

    def spy(pairs, df, nodes, text_col, width, name):
        out = real(pairs, df, nodes, text_col, width, name)
        asked[name] = {frozenset((r["u"], r["v"])) for r in out.collect()}
        return out

    monkeypatch.setattr(jaccard, "similar_pairs", spy)
    kept = {r["doc_id"] for r in simhash.drop_near_copies(df).collect()}
    node = [jaccard.node_of(np.unique(s)) for s in sets]
    assert asked["print"] == {frozenset((node[a], node[b])) for a, b in want}
    assert asked["first"] == {frozenset((node[a], node[b])) for a, b in alike - want}
    assert kept == set(range(len(texts))) - {b for _, b in alike}


def test_near_stage_names_rows_not_ids(spark):
    """Ids that several rows have, or none: near copies with one id go but for one, and so do those without an id; another
    text that has the id of a near copy stays."""
    plain = lambda kind: " ".join(f"{kind}{i}" for i in range(100))
    a, b, c, d = map(plain, "abcd")
    rows = [
        (1, a, "x"), (1, a + " z", "x"), (2, a + " y", "x"), (2, b, "x"),  # the smallest id twice, the next on another text too
        (3, c, "y"), (3, c, "x"), (4, c, "x"),  # one text on one id
        (None, d + " z", "x"), (None, d, "x"), (None, d, "w"), (None, a + " y", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    want = {(1, a, "x"), (2, b, "x"), (3, c, "x"), (None, d, "w"), (None, a + " y", "x")}
    got = [tuple(r) for r in kept.collect()]
    assert set(got) == want and len(got) == len(want)


CLASHES = ["gone", "sha", "by_id", "rank", "taken_id", "times", "words", "copy", "held_out", "node", "label", "u", "v", "keys", "bits", "n", "fp"]


def through(spark, docs):
    """The rows after each stage but the last, and the last stage's."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, ""), name)
        out.append(docs)
    return out


def test_empty_table_passes(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    stages = through(spark, docs)
    assert [d.count() for d in stages] == [0] * 5
    assert all(d.columns == NAMES for d in stages[:-1])


def test_nulls_repeats_and_clashing_names_pass(spark):
    pytest.importorskip("public_tokenizers")
    rows = corpus()[:60]
    rows += rows[:5] + [(None, rows[6][1], None, None, None), (None, rows[7][1] + " more", "aa", "x", 1), (900, rows[8][1], None, None, None)]
    full = [(*r, *range(len(CLASHES))) for r in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHES))
    stages = through(spark, docs)
    assert all(d.columns == NAMES + CLASHES for d in stages[:-1])
    assert all(tuple(r)[5:] == tuple(range(len(CLASHES))) for d in stages[:-1] for r in d.collect())
    exact = [r["doc_id"] for r in stages[1].collect()]
    assert exact.count(rows[0][0]) == 1 and 900 not in exact and exact.count(None) == 1  # 6 and 8 have smaller ids
    assert None in [r["doc_id"] for r in stages[2].collect()]
    assert stages[4].count() == stages[3].count()


def test_a_very_long_text_passes_whole(spark):
    pytest.importorskip("public_tokenizers")
    rng = random.Random(3)
    words = ["".join(rng.choice(["ka", "lo", "mi", "ru"]) for _ in range(rng.randint(1, 5))) for _ in range(200_000)]
    long = " ".join(words)  # over a million characters
    assert len(long) > 1_000_000
    rows = [(r[0], r[1], "aa", "x", 0) for r in corpus()[:30]] + [(500, long, "aa", "x", 0), (501, long.replace(" ", "\n"), "aa", "x", 0), (502, long + " end", "aa", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = through(spark, docs)
    kept = lambda k: {r["doc_id"] for r in stages[k].collect()} & {500, 501, 502}
    assert (kept(0), kept(1), kept(2)) == ({500, 501, 502}, {500, 502}, {500})
    last = {r["doc_id"]: r for r in stages[4].collect()}
    if 500 in last:
        assert last[500]["decoded_sha256"] == hashlib.sha256(long.encode()).hexdigest()
