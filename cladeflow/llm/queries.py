"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from cladeflow.llm import bpe as _bpe
from cladeflow.llm import class_lm as _class_lm
from cladeflow.llm import dominance as _dominance
from cladeflow.llm import exact_dedup as _exact
from cladeflow.llm import language_id as _language
from cladeflow.llm import near_dedup as _near
from cladeflow.llm import packed_output as _packed
from cladeflow.llm import packing as _packing
from cladeflow.llm import quality as _quality
from cladeflow.llm import rank_bpe as _ranks
from cladeflow.llm import resample as _resample
from cladeflow.llm import secrets as _secrets
from cladeflow.llm import url_filter as _urls
from cladeflow.llm.common import table


def op1_packed_ids(spark, sf_dir):
    return _packed.packed_sequences(table(spark, sf_dir, "documents"))


def op2_class_lm(spark, sf_dir):
    return _class_lm.class_lm(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark, sf_dir):
    return _packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark, sf_dir):
    return _secrets.secret_scan(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark, sf_dir):
    return _near.near_dedup(table(spark, sf_dir, "documents"), width=4, percent=80)


def op6_bpe(spark, sf_dir):
    return _bpe.bpe_digests(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark, sf_dir):
    return _quality.quality(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark, sf_dir):
    return _exact.exact_dedup(table(spark, sf_dir, "documents"))


def op9_url_filter(spark, sf_dir):
    return _urls.url_filter(table(spark, sf_dir, "pages"))


def op10_language_id(spark, sf_dir):
    return _language.language_id(table(spark, sf_dir, "documents"))


def op11_rank_bpe(spark, sf_dir):
    return _ranks.rank_digests(table(spark, sf_dir, "documents"))


def op12_dominance_counts(spark, sf_dir):
    return _dominance.sales_above(table(spark, sf_dir, "sales"))


def op13_importance_resample(spark, sf_dir):
    return _resample.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql():
    return {"op8_exact_dedup": EXACT_SQL, "op12_dominance_counts": DOMINANCE_SQL, "op13_importance_resample": RESAMPLE_SQL}


EXACT_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare FROM documents),
w AS (SELECT doc_id, bare,
  first_value(doc_id) OVER (PARTITION BY bare ORDER BY length(x) DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY bare) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM w
"""

#: crc32 of a list of bytes, as DuckDB has no such function: the table of a byte's remainders, and the fold over the bytes.
_CRC_TABLE = "SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS tab FROM range(256) r(i)"
_CRC = "xor(list_reduce({bytes}, lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), 4294967295), 4294967295)"

DOMINANCE_SQL = f"""
WITH k AS ({_CRC_TABLE}),
p AS (SELECT sale_id, CAST(floor(floor(epoch(sold_at)) / 86400) AS BIGINT) AS slot, CAST(floor(floor(100 * total + 0.5) / 1000) AS BIGINT) AS level,
  1 + {_CRC.format(bytes="list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 3 AS w FROM sales, k),
c AS (SELECT slot, level, count(*) AS n, sum(w) AS w FROM p WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY slot, level),
g AS (SELECT slot, level, coalesce(n, 0) AS n, coalesce(w, 0) AS w FROM (SELECT DISTINCT slot FROM c) CROSS JOIN (SELECT DISTINCT level FROM c) LEFT JOIN c USING (slot, level)),
e AS (SELECT slot, level, sum(n) OVER (PARTITION BY level ORDER BY slot) AS n, sum(w) OVER (PARTITION BY level ORDER BY slot) AS w FROM g),
a AS (SELECT slot, level, coalesce(sum(n) OVER higher, 0) AS n, coalesce(sum(w) OVER higher, 0) AS w FROM e
  WINDOW higher AS (PARTITION BY slot ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT sale_id, p.slot, p.level, CAST(a.n AS BIGINT) AS n_sales, CAST(a.w AS BIGINT) AS n_rows FROM p LEFT JOIN a ON a.slot = p.slot AND a.level = p.level
"""

_FEATURES = """SELECT id, words, list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS feats FROM (
  SELECT {id} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM {table})"""

RESAMPLE_SQL = f"""
WITH k AS ({_CRC_TABLE}),
d AS ({_FEATURES.format(id="doc_id", table="documents")}),
q AS ({_FEATURES.format(id="item_id", table="benchmark")}),
df AS (SELECT id, f, count(*) AS n FROM (SELECT id, unnest(feats) AS f FROM d) GROUP BY id, f),
qf AS (SELECT f, count(*) AS n FROM (SELECT unnest(feats) AS f FROM q) GROUP BY f),
h AS (SELECT f, {_CRC.format(bytes="list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))")} % 10000 AS bucket
  FROM (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM qf)), k),
s AS (SELECT bucket, sum(n) AS n FROM df JOIN h USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM qf JOIN h USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(n), 0) FROM s) + 10000 AS DOUBLE)
  / (CAST(s.n + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(n), 0) FROM t) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT id, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM df JOIN h USING (f) JOIN g USING (bucket) GROUP BY id),
z AS (SELECT d.id AS doc_id, len(words) AS n_words, CAST(len(feats) AS BIGINT) AS n_features, coalesce(w.weight, 0) AS weight,
  coalesce(w.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || CAST(d.id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN w ON w.id = d.id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS total FROM z WHERE n_words >= 20)
SELECT z.doc_id, n_features, weight, score, CASE WHEN r.rank <= 25 * r.total // 100 THEN r.rank END AS rank FROM z LEFT JOIN r ON r.doc_id = z.doc_id
"""
