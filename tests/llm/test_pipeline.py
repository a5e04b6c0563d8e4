"""The pipeline's stages on the driver's smallest tables, against what plain Python says of each stage's input."""

import collections
import random

import corpus_pipeline
import pytest
from courier.llm import line_templates, registry, toxicity
from courier.llm.common import cut_table
from pyspark.sql import functions as F

from .test_operators import brute_components, brute_hits, brute_lines, fingerprint, rows_of


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = cut_table(stage(spark, docs, sf))
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _, _ in stages] == [n for n, _ in corpus_pipeline.STAGES]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_toxic_documents_go(spark, sf, stages):
    _, before, after = stages[0]
    model = toxicity.train(before, spark.read.parquet(f"{sf}/labels.parquet"))
    assert {r[0] for r in after.select("doc_id").collect()} == {r["doc_id"] for r in toxicity.score(before, model).collect() if r["score"] < 0.7}


def test_recurring_lines_go_and_documents_stay(stages):
    _, before, after = stages[1]
    assert sorted(rows_of(after)) == sorted(brute_lines(rows_of(before)))


def test_templates_of_groups_within_a_leaf(spark):
    head = "all of these lines"
    a, b = [f"{head} " + " ".join(f"{x}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(56)) for x in ("p", "q")]

    def edited(line, k):  # 17 of 60 tokens: with k's edits elsewhere, no place but the head is the same in all
        w = line.split(" ")
        for i in range(17):
            w[4 + (11 * k + i) % 56] = f"edit{chr(97 + k)}{chr(97 + i)}"
        return " ".join(w)

    texts = [*[a] * 3, *[edited(a, k) for k in range(6)], *[b] * 2, *[edited(b, k) for k in range(6, 9)], f"{head} " + " ".join(f"z{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(56))]
    table = spark.createDataFrame([(i, f"own {i}x line\n{t}") for i, t in enumerate(texts)], "doc_id long, text string")
    with_line = lambda df: sorted(i for i, t in rows_of(df) if head in t)
    assert with_line(corpus_pipeline.cut_lines(spark, table, "")) == [0, 9, 14]
    assert corpus_pipeline.cut_lines(spark, table.limit(0), "").count() == 0


def test_wide_templates_are_not_broadcast(spark, monkeypatch):
    """What is broadcast is bounded by its bytes, not by its rows; either way the same lines go."""
    lines = ["same words lead here " + " ".join(f"w{'abcdefghij'[(i * j) % 7] if j % 9 == 0 else 'x'}" for j in range(300)) for i in range(9)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    want = sorted(map(tuple, line_templates.drop_templates(docs, grouped=True).collect()))
    sent = []
    broadcast = line_templates.F.broadcast
    monkeypatch.setattr(line_templates, "BROADCAST_NUMBERS", 100)
    monkeypatch.setattr(line_templates.F, "broadcast", lambda df: sent.append(df.columns) or broadcast(df))
    assert sorted(map(tuple, line_templates.drop_templates(docs, grouped=True).collect())) == want
    assert any(t == "" for _, t in want) and sent and not any("top" in columns for columns in sent)


def test_few_lines_left_take_no_more_jobs(spark, monkeypatch):
    """Rounds over few lines are done at once on the driver, with the templates that rounds of jobs give."""
    rng = random.Random(5)
    lines = [(leaf, 1000 * leaf + i, rng.choice([1, 1, 2, 3]), [rng.randrange(3) if p > 1 else 7 for p in range(6 + leaf)]) for leaf in range(-3, 4) for i in range(30)]
    lines = [x for n, x in enumerate(lines) if x[3] not in [y[3] for y in lines[:n] if y[0] == x[0]]] + [(9, 9001, 1, [1, 2]), (9, 9002, 1, [1, 3])]
    table = spark.createDataFrame(lines, "leaf long, masked long, many long, tokens array<long>")
    cuts = []
    cut = line_templates.cut
    monkeypatch.setattr(line_templates, "cut", lambda df: cuts.append(1) or cut(df))
    got = sorted(map(tuple, line_templates.groups(table, 0.7, 3).collect()))
    assert len(cuts) <= 2 and len({t for _, t in got}) > 9
    monkeypatch.setattr(line_templates, "DRIVER_NUMBERS", 0)
    assert sorted(map(tuple, line_templates.groups(table, 0.7, 3).collect())) == got and len(cuts) > 12


def test_one_of_each_group_stays(stages):
    _, before, after = stages[2]
    rows = rows_of(before)
    roots = brute_components([fingerprint(t) for _, t in rows], [i for i, _ in rows], 4)
    assert sorted(rows_of(after)) == sorted(r for r, root in zip(rows, roots) if r[0] == root)


def test_contaminated_documents_go(spark, sf, stages):
    _, before, after = stages[3]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = {r[0]: r for r in brute_hits(rows_of(before), items)}
    kept = dict(rows_of(after))
    assert set(kept) == {i for i, r in found.items() if not r[5]}
    assert all(kept[i] == t for i, t in rows_of(before) if i in kept and not found[i][2])


def test_every_kept_document_is_packed(stages):
    _, before, after = stages[4]
    got = after.collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in rows_of(before)}
    size = collections.Counter()
    for r in got:
        assert len(r["ids"]) == r["length"]
        size[r["sequence_id"]] += r["length"]
    assert max(size.values()) <= 2048


def test_run_gives_the_last_stage(spark, sf, stages):
    keys = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select(keys).collect())) == sorted(map(tuple, stages[-1][2].select(keys).collect()))


def test_every_operator_has_its_query(spark, sf):
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_agree_with_their_sql(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = c.sql(registry.oracle_sql()[name])
    columns = sorted(want.columns)
    got = registry.queries()[name](spark, sf).select(*[F.col(x) for x in columns]).collect()
    rows = want.project(", ".join(f'"{x}"' for x in columns)).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows))


def test_line_templates_agree_with_their_sql_where_groups_differ(spark, tmp_path):
    """The driver's smaller tables have no leaf in which groups cut other lines than the SQL."""
    import duckdb

    texts = [f"user logged in from {w} after the nightly backup had run without errors" for w in ("lima", "oslo", "rome", "bonn", "riga", "kyiv")]
    other = "user logged in from nowhere else but his own desk under another name"  # as long, with the same leading tokens
    texts = [f"{t}\nthe server went down near {w} for a short while on {i}" for i, (t, w) in enumerate(zip([*texts, other], "abcdefg"))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(registry.oracle_sql()["op2_line_templates"])
    got = registry.queries()["op2_line_templates"](spark, str(tmp_path)).select(*[F.col(x) for x in want.columns]).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    one, many = [sorted(rows_of(line_templates.drop_templates(docs, grouped=g))) for g in (False, True)]
    assert texts != [t for _, t in one] != [t for _, t in many]


def test_a_table_of_some_hundred_thousand_numbers_is_not_held_by_the_driver(spark):
    """The driver holds a broadcast table several times over, so the bound is far below its memory."""
    joined = lambda n: spark.range(10).join(line_templates.bounded(spark.range(n)), "id")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in joined(1000) and "broadcast" not in joined(300_000)
