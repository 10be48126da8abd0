"""How the sources of a language differ in their words: DuckDB counts shards of terms, Spark merges sums and rankings.

1. Each task counts the terms of its texts, some MB at a time, and sums them up by SQL to rows of (lang, source, term).
2. The rows are dealt to shards by the hash of (lang, term) and sorted there; SQL sums a run of keys after the other and
   keeps the terms in at least MIN_DOCS documents of their language, one row a term with its count in each source.
3. Spark adds up the kept terms of each language (V) and the counts of each source (N). SQL then turns the counts of each
   shard into rates p and gives, over the shard's terms, the sum for each pair of sources and the TOP terms of each source.
   A pair's sum over terms that one or both sources lack needs no row a term: terms are taken by their count, and those that
   both have are put right by a join on the term.
4. Spark adds the shards' sums and ranks them.

Defined results: null text, lang or source are ''; equal rows are documents of their own; a source without terms is ranked
like any other; a language of which no term is kept gives pairs of value 0 and no terms; ties are in the order of UTF-8;
an empty table gives an empty result; other columns are ignored. All arithmetic is in integers.

Memory: a task holds the terms of CHUNK_BYTES of text or of one longer text, or CHUNK_ROWS rows of a shard and one term's
sources. The groups of a language go to all tasks: their number is the root of the pairs that the result holds; of many
languages as many at a time as have GROUPS of them.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import batched

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphloom.llm._shared import checkpoint, shared_folder, table

MIN_DOCS = 3
TOP = 200
#: Bytes of texts that a task counts at once, and beyond which a single text is read term by term.
CHUNK_BYTES = 16 << 20
#: Rows of a shard that are summed up at once, and rows that a task keeps of its results.
CHUNK_ROWS = 400_000
#: Groups that go to all tasks at once.
GROUPS = 200_000

#: Bytes outside ASCII and letters stay, A-Z lower-cased; all others become spaces.
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")


def _terms(raw: bytes) -> Counter:
    if len(raw) <= CHUNK_BYTES:
        return Counter(raw.translate(_LETTERS).split())
    found: Counter = Counter()
    for some in batched(_TERM.finditer(raw), 1 << 16):
        found.update(m[0].translate(_LETTERS) for m in some)
    return found


def _connect() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(config={"threads": 1, "temp_directory": ""})


def _run(con: duckdb.DuckDBPyConnection, sql: str) -> pa.Table:
    return con.sql(sql).to_arrow_table()


def _count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, n, docs) for each CHUNK_BYTES of texts."""
    con = _connect()
    of: dict[tuple[str, str], int] = {}
    groups, terms, counts, sizes, held = [], [], [], [], 0

    def summed() -> Iterator[pa.RecordBatch]:
        names = list(of)
        con.register("names", pa.table({"g": pa.array(range(len(names)), pa.int64()), "lang": pa.array([a for a, _ in names], pa.string()), "source": pa.array([b for _, b in names], pa.string())}))
        con.register("found", pa.table({"g": np.repeat(np.array(groups, np.int64), sizes), "term": pa.array(terms, pa.binary()).cast(pa.string()), "n": pa.array(counts, pa.int64())}))
        yield from _run(con, "SELECT lang, source, term, n, docs FROM (SELECT g, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM found GROUP BY ALL) JOIN names USING (g) ORDER BY lang, term").to_batches(1 << 16)

    for b in batches:
        for lang, source, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
            found = _terms(raw)
            groups.append(of.setdefault((lang, source), len(of)))
            terms += found
            counts += found.values()
            sizes.append(len(found))
            held += len(raw)
            if held >= CHUNK_BYTES:
                yield from summed()
                groups, terms, counts, sizes, held = [], [], [], [], 0
    if groups:
        yield from summed()


def _keep_terms(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows to one row a kept term; the last term of a run of rows waits for the next run."""
        con = _connect()
        rest = None

        def summed(rows: list, last: bool) -> tuple[pa.Table, pa.Table]:
            new = pa.Table.from_batches(rows) if rows else rest.slice(0, 0)
            con.register("rows", new if rest is None else pa.concat_tables([rest, new.cast(rest.schema)]))
            con.execute("CREATE OR REPLACE TABLE sums AS SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM rows GROUP BY ALL")
            con.execute("CREATE OR REPLACE TABLE ends AS SELECT lang, term FROM sums " + ("WHERE false" if last else "ORDER BY lang DESC, term DESC LIMIT 1"))
            done = _run(con, f"SELECT lang, term, list(source) AS sources, list(n) AS counts FROM sums ANTI JOIN ends USING (lang, term) GROUP BY lang, term HAVING sum(docs) >= {least} ORDER BY lang, term")
            return done, _run(con, "SELECT sums.* FROM sums SEMI JOIN ends USING (lang, term)")

        rows, held = [], 0
        for b in batches:
            rows.append(b)
            held += b.num_rows
            if held >= CHUNK_ROWS:
                done, rest = summed(rows, False)
                yield from done.to_batches(1 << 14)
                rows, held = [], 0
        if rows or rest is not None:
            yield from summed(rows, True)[0].to_batches(1 << 14)

    return run


def kept_terms(documents: DataFrame, least: int = MIN_DOCS) -> DataFrame:
    """lang, term, sources and counts of each term in at least `least` documents of its language, written in the shared folder."""
    spark = documents.sparkSession
    texts = documents.select(*(F.coalesce(documents[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = texts.mapInArrow(_count_texts, "lang string, source string, term string, n long, docs long")
    shards = counted.repartition("lang", "term").sortWithinPartitions("lang", "term")
    folder = f"{shared_folder(spark)}/terms-{uuid.uuid4().hex}"
    shards.mapInArrow(_keep_terms(least), "lang string, term string, sources array<string>, counts array<long>").write.parquet(folder)
    return spark.read.parquet(folder)


def groups(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, v (kept terms of the language), n (their count in the source) and lang_n (in the language)."""
    named = documents.select(*(F.coalesce(documents[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    at = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("at")).select("lang", "at.sources", "at.counts")
    sums = at.groupBy("lang", F.col("sources").alias("source")).agg(F.sum("counts").alias("n"))
    v = kept.groupBy("lang").agg(F.count("*").alias("v"))
    lang_n = sums.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    none = F.lit(0).cast("long")
    found = named.join(sums, ["lang", "source"], "left").join(v, "lang", "left").join(lang_n, "lang", "left")
    return checkpoint(found.select("lang", "source", *(F.coalesce(c, none).alias(c) for c in ("v", "n", "lang_n"))))


_RATE = "1 + CAST(1000000000 * CAST({n} + 1 AS HUGEINT) // {of} AS BIGINT)"
_F = "({p} - {q}) * ({p} - {q}) // {q}"
#: Tables of a shard: cells (id, lang, source, n, total, term), and groups (lang, source, p0, den, lang_den).
_CELLS = f"""
CREATE OR REPLACE TABLE rates AS
SELECT c.id, c.lang, c.source, c.term, {_RATE.format(n="c.n", of="g.den")} AS p, g.p0, {_RATE.format(n="c.total", of="g.lang_den")} AS q
FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY id) AS HUGEINT) AS total
      FROM (SELECT id, lang, term, unnest(sources) AS source, unnest(counts) AS n FROM kept)) c JOIN groups g USING (lang, source)"""
_PAIRS = f"""
WITH shared AS (
  SELECT a.lang, a.source, b.source AS item,
         sum(CAST({_F.format(p="a.p", q="b.p")} AS HUGEINT) - {_F.format(p="a.p", q="b.p0")} - {_F.format(p="a.p0", q="b.p")} + {_F.format(p="a.p0", q="b.p0")}) AS value
  FROM rates a JOIN rates b ON a.id = b.id AND a.source <> b.source GROUP BY ALL),
alike AS (SELECT lang, source, p, p0, count(*) AS k FROM rates GROUP BY ALL),
mine AS (
  SELECT h.lang, h.source, g.source AS item, sum(CAST(k AS HUGEINT) * ({_F.format(p="h.p", q="g.p0")} - {_F.format(p="h.p0", q="g.p0")})) AS value
  FROM alike h JOIN groups g ON h.lang = g.lang AND h.source <> g.source GROUP BY ALL),
theirs AS (
  SELECT h.lang, g.source, h.source AS item, sum(CAST(k AS HUGEINT) * ({_F.format(p="g.p0", q="h.p")} - {_F.format(p="g.p0", q="h.p0")})) AS value
  FROM alike h JOIN groups g ON h.lang = g.lang AND h.source <> g.source GROUP BY ALL),
neither AS (
  SELECT a.lang, a.source, b.source AS item, CAST(k AS HUGEINT) * ({_F.format(p="a.p0", q="b.p0")}) AS value
  FROM (SELECT lang, count(*) AS k FROM kept GROUP BY lang) JOIN groups a USING (lang) JOIN groups b ON a.lang = b.lang AND a.source <> b.source)
SELECT lang, source, item, CAST(sum(value) AS BIGINT) AS value
FROM (FROM shared UNION ALL FROM mine UNION ALL FROM theirs UNION ALL FROM neither) GROUP BY ALL"""
_BEST = f"SELECT lang, source, term AS item, {_F.format(p='p', q='q')} AS value FROM rates WHERE p > q"
_RANKED = "QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {top}"


def _judge_shards(told: list[tuple], top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connect()
        columns = list(zip(*told, strict=True))
        con.register("told", pa.table({k: pa.array(c, pa.string() if i < 2 else pa.int64()) for i, (k, c) in enumerate(zip(("lang", "source", "v", "n", "lang_n"), columns, strict=True))}))
        con.execute(f"CREATE TABLE groups AS SELECT lang, source, n + v AS den, lang_n + v AS lang_den, {_RATE.format(n='0', of='(n + v)')} AS p0 FROM told WHERE v > 0")
        for kind in ("sums", "best"):
            con.execute(f"CREATE TABLE {kind} (lang VARCHAR, source VARCHAR, item VARCHAR, value BIGINT)")

        def given(least: int) -> Iterator[pa.RecordBatch]:
            for kind, part in (("sums", "pair"), ("best", "term")):
                if _run(con, f"SELECT count(*) FROM {kind}").column(0)[0].as_py() > least:
                    yield from _run(con, f"SELECT lang, source, '{part}' AS part, item, value FROM {kind}").to_batches(1 << 16)
                    con.execute(f"DELETE FROM {kind}")

        def judge(rows: list[pa.RecordBatch]) -> None:
            some = pa.Table.from_batches(rows)
            con.register("kept", some.append_column("id", pa.array(np.arange(some.num_rows))))
            con.execute(_CELLS)
            con.execute(f"CREATE OR REPLACE TABLE sums AS SELECT lang, source, item, CAST(sum(value) AS BIGINT) AS value FROM (FROM sums UNION ALL ({_PAIRS})) GROUP BY ALL")
            con.execute(f"CREATE OR REPLACE TABLE best AS SELECT * FROM (FROM best UNION ALL {_BEST}) {_RANKED.format(top=top)}")

        rows, held = [], 0
        for b in batches:
            rows.append(b)
            held += len(b.column(2).flatten())
            if held >= CHUNK_ROWS:
                judge(rows)
                rows, held = [], 0
                yield from given(CHUNK_ROWS)
        if held:
            judge(rows)
        yield from given(0)

    return run


def _blocks(found: DataFrame) -> Iterator[list[tuple]]:
    """The groups in the order of their languages, GROUPS at a time, a language's together."""
    block: list[tuple] = []
    for row in found.orderBy("lang").toLocalIterator():
        if len(block) >= GROUPS and row[0] != block[-1][0]:
            yield block
            block = []
        block.append(tuple(row))
    if block:
        yield block


def audit(documents: DataFrame, least: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: all other sources of the language, and the `top` terms that a source has more often than its language."""
    kept = kept_terms(documents, least)
    found = groups(documents, kept)
    parts = [
        kept.where(F.col("lang").between(block[0][0], block[-1][0])).select("lang", "term", "sources", "counts").mapInArrow(_judge_shards(block, top), "lang string, source string, part string, item string, value long")
        for block in _blocks(found)
    ]
    if not parts:
        return documents.sparkSession.createDataFrame([], "lang string, source string, part string, item string, value long, rank int")
    judged = parts[0]
    for p in parts[1:]:
        judged = judged.unionByName(p)
    judged = checkpoint(judged)
    names = found.select("lang", "source")
    pairs = names.join(names.withColumnRenamed("source", "item"), "lang").where(F.col("source") != F.col("item"))
    sums = judged.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = judged.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(terms)


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs),
kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
v AS (
  SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS lang_n FROM kept GROUP BY lang),
named AS (
  SELECT DISTINCT lang, source FROM docs),
own AS (
  SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (
  SELECT lang, source, CAST(coalesce(sum(n), 0) AS BIGINT) AS all_n FROM named LEFT JOIN own USING (lang, source) GROUP BY lang, source),
rates AS (
  SELECT s.lang, s.source, k.term, coalesce(o.n, 0) AS n,
         1 + CAST(1000000000 * CAST(coalesce(o.n, 0) + 1 AS HUGEINT) // (s.all_n + v.v) AS BIGINT) AS p,
         1 + CAST(1000000000 * CAST(k.n + 1 AS HUGEINT) // (v.lang_n + v.v) AS BIGINT) AS q
  FROM sizes s JOIN v USING (lang) JOIN kept k ON k.lang = s.lang LEFT JOIN own o ON o.lang = s.lang AND o.source = s.source AND o.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
  FROM rates a JOIN rates b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM named a JOIN named b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM rates WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200
"""
