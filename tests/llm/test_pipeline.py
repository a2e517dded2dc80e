from tests.llm.test_dedup import brute as near_brute
from tests.llm.test_packing import check
from tests.llm.test_repeats import brute as repeats_brute

import corpus_pipeline
from wayline.llm.mixing import mix_sources
from wayline.llm.quality import quality_rules

DIR = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(path := f"{tmp_path}/{k}")
        out[name] = docs = spark.read.parquet(path)
    source = {r.doc_id: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    kept = {r.doc_id for r in quality_rules(spark.read.parquet(f"{DIR}/documents.parquet")).where("kept").collect()}
    first = {r.doc_id: r for r in out["quality_rules"].collect()}
    assert first == {d: source[d] for d in kept} and 100 < len(first) < 200
    near = near_brute([(d, r.text) for d, r in first.items()], 80)
    second = {r.doc_id: r for r in out["minhash_near_dedup"].collect()}
    assert second == {d: first[d] for d, x in near.items() if x[2]}
    third = {r.doc_id: r for r in out["suffix_array_dedup"].collect()}
    want = {x[0]: x[4].decode("utf-8", "ignore") for x in repeats_brute([(d, r.text) for d, r in second.items()], 250)}
    assert {d: r.text for d, r in third.items()} == want
    assert all((r.lang, r.source, r.n_chars) == (source[d].lang, source[d].source, len(r.text)) for d, r in third.items())
    fourth = {r.doc_id: r for r in out["mixing"].collect()}
    chosen = {r.doc_id for r in mix_sources(out["suffix_array_dedup"]).where("_chosen").collect()}
    assert fourth == {d: third[d] for d in chosen} and 0.2 < len(fourth) / len(third) < 0.9
    check(out["packing"].collect(), {d: r.text for d, r in fourth.items()})


def test_run_and_columns(spark):
    assert corpus_pipeline.run(spark, DIR).columns[:3] == ["doc_id", "start", "length"]
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DIR).columns == docs.columns


def test_one_row_of_each_group_stays(spark, tmp_path):
    """Repeated rows, null ids and one id with two texts; all texts are over 400 bytes, as the next stage cuts those."""
    text = {c: " ".join(f"{c}{i}" for i in range(150)) for c in "abcde"}
    near = text["c"] + " more"
    rows = [(1, text["a"]), (1, text["a"]), (2, text["b"]), (None, text["b"]), (None, near), (3, text["c"]), (3, text["d"]), (4, text["d"]), (None, text["e"]), (None, text["e"])]
    docs = spark.createDataFrame([(*r, "en", "web", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    stages["minhash_near_dedup"](spark, docs, DIR).write.parquet(f"{tmp_path}/near")
    out = spark.read.parquet(f"{tmp_path}/near")
    want = sorted([(1, text["a"]), (2, text["b"]), (3, text["c"]), (3, text["d"]), (None, text["e"])], key=str)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == want
    after = stages["suffix_array_dedup"](spark, out, DIR).collect()
    assert sorted(((r.doc_id, r.text) for r in after), key=str) == want


def test_copies_from_four_fifths_go(spark):
    """196 of 5-word shingles each; one changed word in the middle takes 5 of them: 4 changes leave 0.815, 5 leave 0.774."""
    from wayline.llm.dedup import layout, without_copies

    rows = []
    for g in range(60):
        words = [f"g{g}w{i}" for i in range(200)]
        rows.append((3 * g, " ".join(words)))
        for n in (4, 5):
            rows.append((3 * g + n - 3, " ".join(f"n{n}w{i}x{g}" if i in range(20, 20 + 30 * n, 30) else w for i, w in enumerate(words))))
    docs = spark.createDataFrame([(*r, "en", "web", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = near_brute(rows, 80)
    got = {r.doc_id for r in without_copies(docs, 5, 80).collect()}
    assert got == {d for d, x in near.items() if x[2]} and len(got) == 120
    assert layout(85) == (16, 22) and layout(80) == (22, 27)


def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and clashing names; an empty table at each stage."""
    long = " ".join(f"w{i}" for i in range(60_000))
    plain = " ".join(f"p{i}" for i in range(300))
    rows = [(1, plain, "en", "web", 1), (1, plain, "en", "web", 1), (2, None, "en", "web", 0), (3, "", None, "web", 0), (None, plain + " x", "en", None, None), (None, None, None, None, None), (4, long, "de", "hot", 9)]
    docs = spark.createDataFrame([(*r, 0.5, "t", 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _weight double, topic string, tokens int")
    stages = dict(corpus_pipeline.STAGES)

    def out(name, of):
        stages[name](spark, of, DIR).write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    # base rules fail what has no words; a repeated passage isn't one within a text here
    judged = out("quality_rules", docs)
    assert judged.columns == corpus_pipeline.COLUMNS and {r.text for r in judged.collect()} <= {plain, plain + " x", long}
    cut = {(r.doc_id, r.text) for r in out("suffix_array_dedup", docs).collect()}
    assert (2, "") in cut and (3, "") in cut and (None, "") in cut and (4, long) in cut and (1, "") in cut
    mixed = [tuple(r) for r in out("mixing", docs).collect()]
    assert set(mixed) <= set(rows) and mixed.count(rows[0]) in (0, 2)
    packed = out("packing", docs).collect()
    assert sum(r.start == 0 for r in packed) == len(rows) and sum(r.length for r in packed if r.doc_id == 4) > 60_000
    empty = spark.createDataFrame([], docs.schema)
    for name in stages:
        assert out(name, empty).count() == 0, name
