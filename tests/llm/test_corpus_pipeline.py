"""The pipeline, stage by stage, on rows with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netstate.llm import near_copies, queries, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": [f"{a}{b}" for a in ("the", "and", "with", "this", "there") for b in (
    "", "ing", "ould", "ther", "ness", "ful")],
    "de": [f"{a}{b}" for a in ("der", "und", "schön", "über", "nicht") for b in (
        "", "keit", "ung", "lich", "chen", "heit")]}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "", ".\n", ","])
                    + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        rows.append([i, prose(rng, lang, rng.randrange(80, 300)), lang])
    bench = [(i, prose(rng, "en", 30).replace("\n", " ")) for i in range(5)]
    copy = rows[7][1]
    rows += [[100, copy, "en"], [101, copy, "en"], [102, rows[8][1] + " " + bench[2][1], "en"],
             [103, None, "en"], [104, "", None], [105, "12 34 !!", "de"], [106, bench[3][1], None],
             [107, prose(rng, "en", 90), None], [107, prose(rng, "en", 90), None],
             [None, prose(rng, "de", 90), "de"]]
    root = tmp_path_factory.mktemp("corpus")
    frame = [(d, t, lang, "s", None if t is None else len(t)) for d, t, lang in rows]
    spark.createDataFrame(frame, SCHEMA).write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(
        str(root / "benchmark.parquet"))
    return str(root)


def test_stages_keep_columns_and_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == columns
        left.append({r.doc_id for r in docs.collect()})
    assert {103, 104, 105}.isdisjoint(left[0]) and {0, 7, 100, 101, 102, 106, 107} <= left[0]
    assert left[0] == left[1]
    # What is left of a copy without its lines is empty, and one empty text stays.
    assert len({100, 101} & left[2]) <= 1 and set(range(60)) <= left[2]
    assert None in left[2] and {102, 106}.isdisjoint(left[3])
    assert set(range(60)) - {8} <= left[3]


def edited(rng, words, least, most):
    """A copy with replaced words whose similarity lies between two bounds."""
    def shingles(w):
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    out, own = list(words), shingles(words)
    while True:
        other = shingles(out)
        similarity = len(own & other) / len(own | other)
        if similarity <= most:
            return " ".join(out) if similarity >= least else edited(rng, words, least, most)
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"


def test_edited_copies_go(spark):
    rng = random.Random(3)
    rows, near = [], set()
    for i in range(150):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(150, 400))]
        rows.append((i, " ".join(words)))
        low = [0.82, 0.88, 0.95, 0.70][i % 4]
        rows.append((1000 + i, edited(rng, words, low - 0.02, low + 0.02)
                     if low > 0.8 else edited(rng, words, low - 0.05, low + 0.05)))
        if low > 0.8:
            near.add(1000 + i)
    # A large group of copies of one text, and a chain: each near the next, its ends not.
    words = [f"w{rng.randrange(3000)}" for _ in range(300)]
    rows += [(2000 + i, edited(rng, words, 0.86, 0.92)) for i in range(120)]
    chain = words[::-1]
    for i in range(8):
        rows.append((3000 + i, " ".join(chain)))
        chain = edited(rng, chain, 0.84, 0.9).split()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert left == {i for i, _ in rows} - near - set(range(2001, 2120)) - set(range(3001, 3008))


def test_operator_9_names_pairs(spark, monkeypatch):
    """Without bands only fingerprints name pairs; what is not similar enough stays."""
    shared = near_copies._shared
    monkeypatch.setattr(near_copies, "_shared", lambda kept: shared(kept).limit(0))
    rng = random.Random(11)
    words = [[f"{c}{rng.randrange(10**6)}" for _ in range(60)] for c in "xy"]
    fill = ["all", "work", "and", "no", "play"] * 400
    long = [f"w{rng.randrange(3000)}" for _ in range(3000)]
    rows = [(1, " ".join(words[0] + fill)), (2, " ".join(words[1] + fill)), (3, " ".join(long)),
            (4, " ".join([*long, "end"])), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert groups[2] == 1 and groups[4] == 3
    left = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(left, key=str) == [1, 2, 3, None]


def test_copies_of_texts_with_a_common_frame(spark):
    """600 texts share two thirds of their words: every band value holds most of them."""
    rng = random.Random(7)
    frame = [f"f{rng.randrange(5000)}" for _ in range(240)]
    rows, pairs = [], []
    for i in range(300):
        own = [f"w{rng.randrange(10**6)}" for _ in range(64)]
        words = frame[:120] + own[:32] + frame[120:] + own[32:]
        low = 0.807 if i % 2 else 0.851
        rows += [(2 * i, " ".join(words)), (2 * i + 1, edited(rng, words, low - 0.006, low + 0.01))]
        pairs.append((2 * i, 2 * i + 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    group = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    found = sum(group[a] == group[b] for a, b in pairs)
    assert found >= 0.97 * len(pairs), found
    # No others are that similar.
    assert all(component in (d, d - d % 2) for d, component in group.items())


def test_links_are_exact(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    docs = spark.createDataFrame(
        [*enumerate(texts), (None, "x"), (60, None), (61, " "), (62, "X"), (62, "x y")],
        "doc_id long, text string")
    got = near_copies.near_copies(docs).collect()
    assert len(got) == 65
    sets = {i: set(near_copies.shingle_hashes(t.encode()).tolist()) for i, t in enumerate(texts)}
    group = {r.doc_id: r.component_id for r in got if r.doc_id is not None and r.doc_id < 60}
    for i, x in sets.items():
        near = [j for j, y in sets.items() if len(x & y) >= 0.8 * len(x | y)]
        assert all(group[j] == group[i] for j in near) and group[i] <= min(near)
    assert {r.component_id for r in got if r.doc_id in (60, 61)} == {60}
    assert {r.component_id for r in got if r.doc_id is None} == {62}


def test_pipeline_runs(spark, folder):
    got = queries.QUERIES["pipeline"](spark, folder)
    rows = got.collect()
    assert {r.doc_id for r in rows} >= set(range(60)) - {8}
    fill = got.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(r.n <= 1024 for r in fill)


def test_queries_are_registered():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert "pipeline" in __spark_entry__.queries()
    assert set(queries.ORACLES) <= set(queries.QUERIES)
