import duckdb
from pyspark.sql import functions as F

from wayline.llm.chat import CHAT_SQL, assembled, rotate_speakers
from wayline.llm.mixing import mix_sources, mixing_sql

DIR = "/root/testdata/sf0.01"


def test_mixing_equals_sql(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = mix_sources(docs)
    got = {r.doc_id: (r.source, r.lang, r._topic, r._tokens, r._weight, r._chosen) for r in out.collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = {r[0]: (*r[1:6], r[7]) for r in con.execute(mixing_sql()).fetchall()}
    assert len(got) == len(want) == 1000
    assert all(got[d][:4] == w[:4] and abs(got[d][4] - w[4]) < 1e-5 for d, w in want.items())
    assert sum(got[d][5] == w[5] for d, w in want.items()) == 1000
    cells = out.groupBy("source").agg({"_tokens": "sum"}).collect()
    total = sum(r[1] for r in cells)
    goal = {r[0]: r[1] ** 0.7 for r in cells}
    real = {r[0]: r[1] for r in out.selectExpr("source", "_tokens * _weight as w").groupBy("source").sum("w").collect()}
    for s, g in goal.items():
        assert abs(real[s] / total - g / sum(goal.values())) < 0.01


def capped(want, most):
    """Shares of a total that nobody exceeds; what is over goes to the others in proportion."""
    total, out, free = sum(want.values()), {}, set(want)
    scale = 1.0
    while True:
        scale = (total - sum(out.values())) / sum(want[v] for v in free)
        over = {v for v in free if want[v] * scale > most[v]}
        if not over:
            return out | {v: want[v] * scale for v in free}
        out |= {v: most[v] for v in over}
        free -= over


def test_expected_tokens_meet_the_marginals(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = mix_sources(docs).collect()
    total = sum(r._tokens for r in rows)
    assert max(r._probability for r in rows) <= 1
    for key in ("source", "lang", "_topic"):
        have, got = {}, {}
        for r in rows:
            have[r[key]] = have.get(r[key], 0) + r._tokens
            got[r[key]] = got.get(r[key], 0) + r._tokens * r._probability
        power = {v: n**0.7 for v, n in have.items()}
        goal = {v: x / sum(power.values()) * total for v, x in power.items()}
        goal = capped(goal, {v: n / 0.5 for v, n in have.items()})
        assert all(abs(got[v] - 0.5 * goal[v]) < 0.001 * goal[v] for v in goal), key
    assert abs(sum(r._tokens * r._probability for r in rows) / total - 0.5) < 1e-4


def test_targets_beyond_what_there_is(spark):
    """A source that should be nine tenths but has one hundred of a thousand tokens is taken whole."""
    rows = [(i, "abcd" * 10, "en", "few" if i < 10 else f"big{i % 2}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    goal = spark.createDataFrame([("few", 0.9), ("big0", 0.05), ("big1", 0.05), ("absent", 0.3)], "value string, share double")
    got = {r.source: r.p for r in mix_sources(docs, share=0.5, targets={"source": goal}).groupBy("source").agg({"_probability": "avg"}).toDF("source", "p").collect()}
    assert abs(got["few"] - 1) < 1e-6 and all(abs(got[s] - 40 / 90) < 1e-6 for s in ("big0", "big1"))


def test_mixing_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", None), (None, "x|y", None, "s"), (4, "z " * 50000, "en", "s"), (4, "z " * 50000, "en", "s")]
    docs = spark.createDataFrame([(*r, "t", 5) for r in rows], "doc_id long, text string, lang string, source string, topic string, tokens int")
    got = mix_sources(docs).collect()
    assert len(got) == 5 and len({r._chosen for r in got if r.doc_id == 4}) == 1 and all(0 <= r._probability <= 1 for r in got)
    assert mix_sources(docs.limit(0)).count() == 0
    goal = spark.createDataFrame([("s", 1.0)], "value string, share double")
    assert not any(r._chosen for r in mix_sources(docs, share=1.0, targets={"source": goal}).collect() if r.source is None)


def test_mixing_keeps_columns_of_its_own_names(spark):
    rows = [(i, "word " * (i % 7), "en", f"s{i % 2}") for i in range(40)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    own = ["_weight", "_Topic", "__topic", "_lot", "lot", "doc", "weight", "tokens", "_source", "_chosen", "topic", "a.b"]
    extra = plain.select("*", *(F.lit(f"mine {c}").alias(c) for c in own))
    out = mix_sources(extra)
    assert out.columns == [*extra.columns, "___topic", "_tokens", "__weight", "_probability", "__chosen"]
    got = {r.doc_id: r for r in out.collect()}
    assert all(r[c] == f"mine {c}" for r in got.values() for c in own)
    added = ["_topic", "_tokens", "_weight", "_probability", "_chosen"]
    want = {r.doc_id: [r[c] for c in added] for r in mix_sources(plain).collect()}
    assert {i: list(r)[-5:] for i, r in got.items()} == want


def test_chat_equals_sql_and_whole_dialogues(spark):
    turns = spark.read.parquet(f"{DIR}/conversations.parquet")
    out = rotate_speakers(turns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DIR}/conversations.parquet'")
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, con.execute(CHAT_SQL).fetchall()))
    r = assembled(out).where("conv_id = 0 and perspective = 'user'").first()
    assert all(r.dialogue[m.start : m.end].startswith("<|assistant|>") for m in r.masks) and r.dialogue.count("<|user assistant|>") == 2


def test_chat_odd_rows(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, 5000, "cy", "x" * 70000), (1, 5000, "cy", "x" * 70000), (None, 0, None, "?"), (3, 0, "system", "rules")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, size int")
    got = rotate_speakers(turns).collect()
    ann = sorted((r.start, r.end, r.role, r.name, r.loss) for r in got if r.perspective == "ann")
    assert len(ann) == 4 and ann[0][2:] == ("assistant", None, True) and ann[1][2:] == ("user", "bob", False)
    assert all(a[1] == b[0] for a, b in zip(ann, ann[1:])) and ann[0][0] == 0
    assert {r.perspective for r in got} == {"ann", "bob", "cy", "unknown"}
    assert rotate_speakers(turns.limit(0)).count() == 0


def test_null_and_empty_conversations_are_two(spark):
    rows = [(None, 0, "ann", "a"), ("", 0, "bob", "b"), ("", 2000, "cy", "c"), ("x", None, "ann", "d")]
    turns = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = sorted(((r.conv_id, r.perspective, r.turn, r.role) for r in rotate_speakers(turns).collect()), key=str)
    assert got == sorted([(None, "ann", 0, "assistant"), ("", "bob", 0, "assistant"), ("", "bob", 2000, "user"), ("", "cy", 0, "user"), ("", "cy", 2000, "assistant"), ("x", "ann", None, "assistant")], key=str)
