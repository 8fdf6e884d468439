"""URL rules and model, the pipeline's stages, and the registry."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cladeflow.llm import queries, stages, url_filter
from tests.llm.conftest import corpus
from tests.llm.test_text_operators import SPACE, brute_near

URLS = [
    "http://a.example.net/en/1", "https://example.net/fr/2?x=1", "http://EXAMPLE.com/de/3#t", "http://x.example.com/fr/4", "http://m.foo.org/fr/5", "http://foo.org/de/6", "http://org/fr/7", "http://notexample.net/en/8", "nothing", "", None,
    "http://example.net", "ftp://u@example.net:80/en/9", "http://host?q=http://b.net/en/", "http://a.net/en/x/y/z.html?p=1&q=2", "http://casino-win.example.org/en/1", "http://free-bets.example.org/de/2", "http://plain.example.org/en/3", "a\nb://c.NET/d",
]


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, name, start in url_filter.RULES:
        if (host == name or host.endswith("." + name)) and path.startswith(start) and (best is None or len(name + start) > len(best[0])):
            best = (name + start, verdict)
    return host, path, best


def pages(spark, urls=URLS):
    more = [f"http://{'casino' if k % 4 == 0 else 'word'}-{k % 7}.example.org/en/{k}" for k in range(200)]
    return spark.createDataFrame([(k, u, "x") for k, u in enumerate([*urls, *more])], "page_id long, url string, html string")


def test_hosts_paths_and_rules(spark):
    df = pages(spark).withColumn("host", F.lit("clash")).withColumn("suffix", F.lit("clash"))
    rows = {r["page_id"]: r for r in url_filter.url_filter(df).collect()}
    assert len(rows) == len(URLS) + 200
    for k, url in enumerate(URLS):
        host, path, rule = brute_url(url)
        r = rows[k]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule[0] if rule else None), url
        assert r["verdict"] == rule[1] if rule else r["verdict"] in ("allow", "block")
    assert rows[URLS.index("http://casino-win.example.org/en/1")]["verdict"] == "block"
    assert rows[URLS.index("http://plain.example.org/en/3")]["verdict"] == "allow"


def test_trees_separate_labelled_urls(spark):
    urls = [(f"http://{'x1y2z3' if k % 2 else 'garden'}{k % 5}.example.org/{'a/' * (k % 3)}", float(k % 2)) for k in range(300)]
    known = spark.createDataFrame(urls, "url string, label double")
    df = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.url_filter(df, rules=(), labelled=known).collect()}
    assert all((got[k] == "block") == bool(y) for k, (_, y) in enumerate(urls))


def test_plan_has_no_python(spark):
    plan = url_filter.url_filter(pages(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_no_pages_and_no_labels(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.url_filter(none).count() == 0
    df = spark.createDataFrame([(1, "http://q.example/a"), (1, "http://q.example/a"), (None, None)], "page_id long, url string")
    nothing = spark.createDataFrame([], "url string, label double")
    assert [r["verdict"] for r in url_filter.url_filter(df, labelled=nothing).collect()] == ["allow"] * 3


ROWS = corpus()


def test_exact_stage_keeps_one_row_of_each_text(spark, docs):
    got = stages.exact_dedup(spark, docs, "")
    assert got.columns == docs.columns
    texts = [SPACE.sub("", r["text"] or "") for r in got.collect()]
    assert sorted(texts) == sorted({SPACE.sub("", r[1] or "") for r in ROWS})


def test_near_stage_keeps_one_of_each_group(spark, docs):
    named = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = [tuple(r) for r in named.collect()]
    got = stages.near_dedup(spark, named, "")
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r[0] for r in brute_near(rows, 5, 80) if r[3])


def test_secret_stage_masks(spark, docs):
    got = stages.secret_scan(spark, docs.withColumn("n_chars", F.length("text").cast("long")), "")
    r = got.filter("doc_id = 116").first()
    assert "[SECRET]" in r["text"] and "9f86d081" not in r["text"] and r["n_chars"] == len(r["text"])
    assert got.filter("text IS NULL").count() == 1 and got.count() == len(ROWS)


def test_stages_survive_odd_columns_and_empty_tables(spark, clashing, empty):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, clashing, "")
        assert got.columns == clashing.columns and got.count() > 0
        assert stage(spark, empty, "").count() == 0
    odd = clashing.withColumn("n_chars", F.lit("none of your numbers"))
    assert stages.secret_scan(spark, odd, "").filter("n_chars = 'none of your numbers'").count() == len(ROWS)


def test_rows_without_id_and_rows_that_repeat(spark, docs):
    words = " ".join(f"word{k}" for k in range(40))
    rows = [(None, words, None, None)] * 4 + [(None, "", None, None)] * 2
    df = spark.createDataFrame(rows, docs.schema)
    assert sorted(r["text"] for r in stages.near_dedup(spark, df, "").collect()) == ["", words]
    assert sorted(r["text"] for r in stages.exact_dedup(spark, df, "").collect()) == ["", words]
    other = " ".join(f"other{k}" for k in range(40))
    rows = [(9, words, "en", "a"), (9, words, "en", "a"), (9, other, "en", "a"), (3, other + " more", None, "b"), (None, words, None, None)]
    got = stages.near_dedup(spark, spark.createDataFrame(rows, docs.schema), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(3, other + " more"), (9, words)]


def test_exact_stage_keeps_the_longest_row_of_an_id(spark, docs):
    rows = [(1, f"a b{' ' * k}c", "en", f"s{k}") for k in range(1, 9)] * 2 + [(2, "a b c", "en", "s")]
    for parts in (1, 5):
        got = stages.exact_dedup(spark, spark.createDataFrame(rows, docs.schema).repartition(parts), "").collect()
        assert [(r["doc_id"], r["text"], r["source"]) for r in got] == [(1, f"a b{' ' * 8}c", "s8")]


def test_pipeline_end_to_end(spark, docs, tmp_path):
    long = docs.withColumn("n_chars", F.length("text").cast("long"))
    long.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    kept = {r["doc_id"] for r in out.collect()}
    assert kept <= {r[0] for r in ROWS} and 115 not in kept and 101 not in kept and 103 in kept
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_registry():
    names = list(queries.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("text", ["", "a b"])
def test_exact_oracle_normalises_alike(text):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT 1 AS doc_id, ? AS text", [text])
    got = con.sql(queries.oracle_sql()["op8_exact_dedup"]).fetchall()[0]
    assert got[4] == hashlib.sha256(text.replace(" ", "").encode()).hexdigest()
