"""Operator 11: source divergence audit by one-hot level products.

Every (lang, source) group is compared with the other sources of its language
over the language's vocabulary: the terms in at least ``MIN_DOCS`` of its
documents. A term's smoothed share of a group depends on its count there only,
so a pair of groups is priced from the joint table of their counts: how many
terms have count a here and count b there. All joint tables come from one
product: terms are rows, (group, count) levels are indicator columns, and the
columns' matrix X gives every table as a block of X'X. Blocks of terms are
multiplied in the tasks (0/1 entries in single precision, at most ``TERMS``
rows, hence exact) with columns in tiles; Spark adds the blocks up. X'X is
symmetric: only the tables of a group with itself or a later one are kept, and
each prices both directions.

Level 0 has no columns: with n the joint and m the marginal counts (the
diagonal of X'X), the sum over all kept terms of f(a, b) is the sum of
n(a, b) (f(a, b) - f(a, 0) - f(0, b) + f(0, 0)), of m(a) (f(a, 0) - f(0, 0)),
of m(b) (f(0, b) - f(0, 0)), and V f(0, 0).

All arithmetic is exact (longs, and decimals in sums). Terms are counted in the tasks
before they are shuffled; a term's rows meet by (lang, term), one per group.
Joint tables are shuffled by pair and level after being added up per task, so
a hot source costs no more than another. A group's ranked terms are cut to
``TOP`` per part of the group before they meet.

Null texts, languages and sources are read as ''; a row is a document, also
when its id repeats. Groups without terms take part with count 0; where a
language keeps no term, its pairs have value 0. Ties are ranked by the item's
UTF-8 bytes. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratebook.llm.common import col, ship, staged, text_runs

MIN_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
TERMS = 4096
TILE = 512
HELD_TERMS = 800_000
RUN_CHARS = 8_000_000
PARTS = 32
# Bytes of terms: ASCII letters in lower case and all bytes of other characters; the rest divides.
_DIVIDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(df: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs): partial counts per task, and a row with a null term per group seen."""
    src = df.select(F.coalesce(col(text_col), F.lit("")).alias("text"), *[
        F.coalesce(col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))])
    schema = "lang string, source string, term string, n long, docs long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for run in text_runs(batch, 0, RUN_CHARS):
                for text, *group in zip(*(run.column(i).to_pylist() for i in range(3)), strict=True):
                    n, docs = held.setdefault(tuple(group), (Counter(), Counter()))
                    words = text.encode().translate(_DIVIDED).split()
                    n.update(words)
                    docs.update(set(words))
                if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                    yield from emit(held)
                    held = {}
        yield from emit(held)

    def emit(held) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [None, *n]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(terms)), pa.array([source] * len(terms)),
                pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])

    ship(df.sparkSession)
    return src.mapInArrow(count, schema)


def kept_terms(counts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, levels): per kept term its groups with their counts; a row with a null term lists the groups."""
    by_group = (counts.repartition("lang", "term").groupBy("lang", "term", "source")
                .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    return (by_group.groupBy("lang", "term")
            .agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("levels"))
            .where(F.col("term").isNull() | (F.col("docs") >= min_docs)).select("lang", "term", "levels"))


def level_products(terms: DataFrame) -> DataFrame:
    """(lang, source, a, other, b, n), source <= other: the blocks of X'X, added up per task; a group with itself gives marginals."""
    schema = "lang string, source string, a long, other string, b long, n long"

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in dict.fromkeys(langs):
                lists = batch.column(1).take(pa.array(np.flatnonzero(langs == lang)))
                flat = lists.flatten()
                sources = flat.field(0).dictionary_encode()
                names, place = np.unique(np.array([s.encode() for s in sources.dictionary.to_pylist()], dtype=object), return_inverse=True)
                names = pa.array(names, pa.binary()).cast(pa.string())
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                levels = np.stack([place.ravel()[sources.indices.to_numpy(zero_copy_only=False)], flat.field(1).to_numpy(zero_copy_only=False)], axis=1)
                columns, column = np.unique(levels, axis=0, return_inverse=True)
                left, right, n = joint_entries(row, column.ravel(), levels[:, 1])
                source, level = names.take(pa.array(columns[:, 0])), pa.array(columns[:, 1])
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(n), pa.string()), source.take(pa.array(left)), level.take(pa.array(left)),
                    source.take(pa.array(right)), level.take(pa.array(right)), pa.array(n)],
                    names=["lang", "source", "a", "other", "b", "n"])

    ship(terms.sparkSession)
    blocked = terms.where("term is not null").select("lang", "levels").mapInArrow(multiply, schema)
    return blocked.groupBy("lang", "source", "a", "other", "b").agg(F.sum("n").alias("n"))


def joint_entries(row: np.ndarray, column: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nonzero entries (i, j, n), i <= j, of X'X, where X has a 1 in each given (row, column).

    Rows are taken in order of their highest level, so that a block's rows share
    columns; a block is halved while its rows need more than a tile of columns.
    """
    highest = np.zeros(row[-1] + 1, dtype=np.int64)
    np.maximum.at(highest, row, level)
    place = np.empty(len(highest), dtype=np.int64)
    place[np.argsort(highest, kind="stable")] = np.arange(len(highest))
    row = place[row]
    order = np.argsort(row, kind="stable")
    row, column = row[order], column[order]
    width = int(column.max()) + 1
    keys, sums = [], []
    start = 0
    while start < len(row):
        size = TERMS
        while True:
            end = int(np.searchsorted(row, row[start] + size))
            used = np.unique(column[start:end])
            if len(used) <= TILE or size == 1:
                break
            size //= 2
        x = np.zeros((row[end - 1] - row[start] + 1, len(used)), dtype=np.float32)
        x[row[start:end] - row[start], np.searchsorted(used, column[start:end])] = 1
        for i in range(0, len(used), TILE):
            for j in range(i, len(used), TILE):
                product = x[:, i:i + TILE].T @ x[:, j:j + TILE]
                at, other = np.nonzero(np.triu(product) if i == j else product)
                keys.append(used[at + i] * width + used[other + j])
                sums.append(product[at, other].astype(np.int64))
        start = end
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.zeros(len(key), dtype=np.int64)
    np.add.at(n, back.ravel(), np.concatenate(sums))
    return key // width, key % width, n


def share(count: str, total: str) -> str:
    """SQL: 1 + floor(SCALE * (count + 1) / (N + V)) in longs, three digits at a time; 1 where the language keeps no term."""
    whole = f"nullif({total} + v, 0)"
    parts, rest = [], f"({count} + 1)"
    for unit in (1_000_000, 1_000, 1):
        parts.append(f"(1000 * {rest} div {whole}) * {unit}")
        rest = f"(1000 * {rest} % {whole})"
    return f"1 + coalesce({' + '.join(parts)}, 0)"


def price(p: str, q: str) -> str:
    """SQL: floor((p - q)^2 / q); shares are at most SCALE + 1, so longs hold sums of four."""
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def total_of(n: str, value: str):
    """The sum of n times a long, in a decimal."""
    return F.sum(F.expr(f"cast({n} as decimal(18,0)) * cast({value} as decimal(19,0))"))


def source_divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                      min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence from each other source, and the terms that set a source apart."""
    terms = staged(kept_terms(term_counts(df, text_col, lang_col, source_col), min_docs), "terms")
    seen = terms.where("term is null").select("lang", F.explode("levels.source").alias("source"))
    each = terms.where("term is not null").select("lang", "term", F.inline("levels"))
    totals = each.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = terms.groupBy("lang").agg(F.count("term").alias("v"), F.coalesce(
        F.sum(F.when(F.col("term").isNotNull(), F.aggregate("levels", F.lit(0).cast("long"), lambda a, x: a + x["n"]))), F.lit(0)).alias("lang_total"))
    groups = staged(seen.join(totals, ["lang", "source"], "left").fillna(0, ["total"]).join(sizes, "lang"), "groups")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pair_values(groups, staged(level_products(terms), "levels"))
    pair_part = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value",
                             F.row_number().over(ranked).alias("rank"))
    salted = Window.partitionBy("lang", "source", "slice").orderBy(F.desc("value"), "item")
    term_part = (_term_values(groups, terms).withColumn("slice", F.expr(f"pmod(xxhash64(item), {PARTS})"))
                 .withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
                 .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
                 .select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
    return pair_part.unionByName(term_part)


def _pair_values(groups: DataFrame, products: DataFrame) -> DataFrame:
    """(lang, source, item, value) per ordered pair of a language's sources, from the joint tables."""
    here = groups.select("lang", "source", "total", "v", F.expr(share("0", "total")).alias("p0"))
    there = here.select("lang", F.col("source").alias("other"), F.col("total").alias("other_total"), F.col("p0").alias("q0"))
    pairs = here.join(there, "lang").where("source <> other")
    def both(x: str, y: str, x0: str, y0: str):
        return total_of("n", f"{price(x, y)} - {price(x, y0)} - {price(x0, y)} + {price(x0, y0)}")
    joint = (products.where("source <> other").join(pairs, ["lang", "source", "other"])
             .withColumn("p", F.expr(share("a", "total"))).withColumn("q", F.expr(share("b", "other_total")))
             .groupBy("lang", "source", "other").agg(both("p", "q", "p0", "q0").alias("there"), both("q", "p", "q0", "p0").alias("back")))
    joint = joint.select("lang", F.inline(F.array(
        F.struct("source", "other", F.col("there").alias("both")),
        F.struct(F.col("other").alias("source"), F.col("source").alias("other"), F.col("back").alias("both")))))
    level = products.where("source = other").select("lang", "source", "a", "n")
    mine = (level.join(pairs, ["lang", "source"]).withColumn("p", F.expr(share("a", "total")))
            .groupBy("lang", "source", "other").agg(total_of("n", f"{price('p', 'q0')} - {price('p0', 'q0')}").alias("left_only")))
    its = (level.select("lang", F.col("source").alias("other"), F.col("a").alias("b"), "n").join(pairs, ["lang", "other"])
           .withColumn("q", F.expr(share("b", "other_total")))
           .groupBy("lang", "source", "other").agg(total_of("n", f"{price('p0', 'q')} - {price('p0', 'q0')}").alias("right_only")))
    keys = ["lang", "source", "other"]
    zero = F.lit(0).cast("decimal(38,0)")
    value = F.expr(f"cast(v as decimal(18,0)) * {price('p0', 'q0')}")
    for c in ("both", "left_only", "right_only"):
        value = value + F.coalesce(F.col(c), zero)
    return (pairs.join(joint, keys, "left").join(mine, keys, "left").join(its, keys, "left")
            .select("lang", "source", F.col("other").alias("item"), value.cast("long").alias("value")))


def _term_values(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms a group holds with a larger share than its language."""
    each = (terms.where("term is not null")
            .select("lang", F.col("term").alias("item"), F.aggregate("levels", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("all_n"),
                    F.inline("levels")))
    return (each.join(groups, ["lang", "source"])
            .withColumn("p", F.expr(share("n", "total"))).withColumn("q", F.expr(share("all_n", "lang_total")))
            .where("n > 0 and p > q").select("lang", "source", "item", F.expr(price("p", "q")).cast("long").alias("value")))


def oracle(table: str = "documents") -> str:
    """The same result in DuckDB SQL, term by term."""
    f = "((p - q) * (p - q)) // q"
    return f"""
with docs as (select row_number() over () as row, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from {table}),
words as (select row, lang, source, unnest(list_transform(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'),
    lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) as term from docs),
kept as (select lang, term from words group by lang, term having count(distinct row) >= {MIN_DOCS}),
counts as (select lang, source, term, count(*) as n from words join kept using (lang, term) group by all),
groups as (select distinct lang, source from docs),
vocab as (select lang, count(*) as v from kept group by lang),
totals as (select lang, source, sum(n) as total from counts group by all),
lang_counts as (select lang, term, sum(n) as n from counts group by all),
lang_totals as (select lang, sum(n) as total from counts group by all),
shares as (select lang, source, term, coalesce(c.n, 0) as n,
    1 + ({SCALE}::hugeint * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + v)::hugeint as p
  from groups join kept using (lang) join vocab using (lang)
  left join totals t using (lang, source) left join counts c using (lang, source, term)),
lang_shares as (select lang, term, 1 + ({SCALE}::hugeint * (n + 1)) // (total + v)::hugeint as q
  from lang_counts join lang_totals using (lang) join vocab using (lang)),
sums as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pair as (select g.lang, g.source, 'pair' as part, o.source as item, coalesce(s.value, 0)::bigint as value
  from groups g join groups o on g.lang = o.lang and g.source <> o.source
  left join sums s on s.lang = g.lang and s.source = g.source and s.item = o.source),
term as (select lang, source, 'term' as part, term as item, ({f})::bigint as value
  from shares join lang_shares using (lang, term) where n > 0 and p > q)
select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from pair
union all
select * from (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from term) where rank <= {TOP}
"""
