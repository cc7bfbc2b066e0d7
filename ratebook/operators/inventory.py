"""Drive listings, paths and upload outcomes.

The reference drives a browser and a REST API one item at a time; here the
same decisions are table operations over listings, work items and attempt
logs.
"""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratebook.functions.dates import parse_api_time
from ratebook.functions.text import col_, mask_filename, retryable, sanitize_reason, strip_unicode

# Listing JSON keys read as text; alternatives are tried left to right.
LISTING_KEYS = ("type", "fileType", "nodeType", "id", "folderId", "fileId", "name", "parentId", "createdAt",
                "gmtCreate", "updatedAt", "gmtModified", "size", "fileSize", "mimeType", "contentType")


def _first_nonempty(*cols) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def parse_listing(df: DataFrame, json_col: str = "json") -> DataFrame:
    """P10 + X18: listing JSON -> DRIVE_ITEM columns; unknown types dropped; size 0 -> null;
    size and MIME for files only; times by the first of four ISO layouts; ``extra`` holds the
    JSON's other keys as text.

    Three stages separated by barriers: parse the JSON once, pick the fields
    once, parse each time once.
    """
    from ratebook.operators.staging import barrier
    keep = [c for c in df.columns if c != json_col]
    j = barrier(df.select(*keep, F.from_json(F.col(json_col), "map<string,string>").alias("_j")))
    g = lambda k: F.try_element_at("_j", F.lit(k))
    kind = _first_nonempty(g("type"), g("fileType"), g("nodeType"))
    fields = barrier(j.select(
        *keep, kind.alias("item_type"),
        F.when(kind == "folder", _first_nonempty(g("id"), g("folderId")))
        .otherwise(_first_nonempty(g("id"), g("fileId"))).alias("id"),
        F.coalesce(g("name"), F.lit("")).alias("name"), g("parentId").alias("parent_id"),
        _first_nonempty(g("createdAt"), g("gmtCreate")).alias("_created"),
        _first_nonempty(g("updatedAt"), g("gmtModified")).alias("_updated"),
        F.coalesce(*[F.nullif(g(k).try_cast("bigint"), F.lit(0).cast("bigint")) for k in ("size", "fileSize")],
                   F.lit(0).cast("bigint")).alias("_size"),
        _first_nonempty(g("mimeType"), g("contentType")).alias("_mime"),
        F.map_filter("_j", lambda k, _: ~k.isin(*LISTING_KEYS)).alias("extra")).where(F.col("item_type").isin("folder", "file")))
    is_file = F.col("item_type") == "file"
    return fields.select(
        *keep, "id", "name", "item_type", "parent_id",
        parse_api_time(F.col("_created")).cast("timestamp_ntz").alias("created_at"),
        parse_api_time(F.col("_updated")).cast("timestamp_ntz").alias("updated_at"),
        F.when(is_file & (F.col("_size") != 0), F.col("_size")).alias("size"),
        F.when(is_file, F.col("_mime")).alias("mime_type"), "extra")


# Fixed value: characters that a path segment must not hold.
ILLEGAL = r'[<>:"|?*]'


def validate_path(path) -> Column:
    """struct(valid, space_label, folders, error) for a ``/`` path.

    Invalid: empty; trailing ``/``; a blank segment; then, segment by segment,
    an illegal character, or a folder name repeated (the first segment, the
    space label, is exempt).
    """
    p = col_(path)
    segs = F.transform(F.split(F.coalesce(p, F.lit("")), "/"), lambda s: strip_unicode(s))
    n = F.size(segs)
    checks = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        i.alias("i"),
        F.element_at(segs, i).rlike(ILLEGAL).alias("illegal"),
        ((i > 1) & (F.array_position(F.slice(segs, 2, F.greatest(i - 2, F.lit(0))), F.element_at(segs, i)) > 0))
        .alias("repeated")))
    bad = F.try_element_at(F.filter(checks, lambda c: c["illegal"] | c["repeated"]), F.lit(1))
    bad_seg = F.element_at(segs, bad["i"])
    error = (F.when(p.isNull() | (p == ""), F.lit("路径不能为空"))
             .when(p.endswith("/"), F.lit("路径尾部存在空段"))
             .when(F.exists(segs, lambda s: s == ""), F.lit("路径包含空段"))
             .when(bad["illegal"], F.concat(F.lit("路径段包含非法字符: "), bad_seg))
             .when(bad["repeated"], F.concat(F.lit("路径存在重复段: "), bad_seg)))
    return F.struct(error.isNull().alias("valid"),
                    F.when(error.isNull(), F.element_at(segs, 1)).alias("space_label"),
                    F.when(error.isNull(), F.array_join(F.slice(segs, 2, n), "/")).alias("folders"),
                    error.alias("error"))


def normalize_parent_id(c) -> Column:
    """trimmed parent id; null, empty, '/', 'root' or 'ROOT' -> 'root'."""
    t = strip_unicode(col_(c))
    return F.when(col_(c).isNull() | t.isin("", "/", "root", "ROOT"), F.lit("root")).otherwise(t)


def normalize_item_name(c) -> tuple[Column, Column]:
    """(trimmed name, error when empty)."""
    t = strip_unicode(F.coalesce(col_(c), F.lit("")))
    return F.when(t != "", t), F.when(t == "", F.lit("Drive item name must not be empty"))


def join_drive_path(*parts) -> Column:
    """fragments stripped of slashes and joined by ``/`` (empty and '.' parts dropped)."""
    pieces = F.concat(*[F.split(F.coalesce(col_(p), F.lit("")), "/") for p in parts])
    kept = F.filter(pieces, lambda s: (s != "") & (s != "."))
    joined = F.array_join(kept, "/")
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def folder_paths(listing: DataFrame) -> DataFrame:
    """Full name path of every folder below the root: (id, path, depth).

    One equi join a level, each level written to the shared scratch folder,
    until a level is empty; there is no depth limit. Folders on a cycle hang
    from no root and so have no path.
    """
    from ratebook.session import scratch_dir
    spark = listing.sparkSession
    folders = listing.where(F.col("item_type") == "folder").select("id", "name", "parent_id")
    base = scratch_dir(spark, "folders")

    def level(frame: DataFrame, depth: int) -> DataFrame:
        path = f"{base}/depth={depth}"
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    folders = level(folders, 0)
    now = level(folders.where(F.col("parent_id") == "root").select("id", F.col("name").alias("path")), 1)
    out, depth = None, 1
    while not now.isEmpty():
        tagged = now.withColumn("depth", F.lit(depth))
        out = tagged if out is None else out.unionByName(tagged)
        depth += 1
        step = folders.join(now.withColumnRenamed("id", "_above"), F.col("parent_id") == F.col("_above")).select(
            "id", F.concat("path", F.lit("/"), "name").alias("path"))
        now = level(step, depth)
    return now.withColumn("depth", F.lit(0)) if out is None else out


def resolve_folders(requests: DataFrame, paths: DataFrame, path_col: str = "path") -> DataFrame:
    """For each requested folder path, the id when it exists, else the first missing prefix.

    Segments are trimmed and blanks dropped; a leading ``root`` is skipped and a
    leading ``id:<folder>`` anchors the rest under that folder. Every prefix
    of the request is matched against the folder paths with one equi join;
    the longest existing prefix decides.
    """
    segs = F.filter(F.transform(F.split(F.col(path_col), "/"), lambda s: strip_unicode(s)), lambda s: s != "")
    r = requests.select(path_col).distinct().select("*", segs.alias("_segs"))
    first = F.try_element_at("_segs", F.lit(1))
    anchored = F.coalesce(first.startswith("id:") & (F.length(first) > 3), F.lit(False))
    r = r.withColumn("_anchor", F.when(anchored, F.substr(first, F.lit(4))))
    r = r.withColumn("_segs", F.when(anchored | F.coalesce(first.isin("root", "ROOT"), F.lit(False)),
                                     F.slice("_segs", 2, F.size("_segs"))).otherwise(F.col("_segs")))
    anchors = paths.select(F.col("id").alias("_anchor"), F.split(F.col("path"), "/").alias("_base"))
    r = r.join(anchors, "_anchor", "left").withColumn(
        "_full", F.when(F.col("_anchor").isNull(), F.col("_segs"))
        .otherwise(F.concat(F.col("_base"), F.col("_segs"))))
    base_n = F.coalesce(F.size("_base"), F.lit(0))
    pre = r.select(path_col, "_anchor", "_segs", "_full", base_n.alias("_b"),
                   F.explode(F.sequence(F.lit(1), F.greatest(F.size("_full"), F.lit(1)))).alias("_k"))
    pre = pre.select(path_col, "_anchor", "_segs", "_full", "_b", "_k",
                     F.array_join(F.slice("_full", 1, F.col("_k")), "/").alias("_prefix"))
    hit = pre.join(paths.select(F.col("path").alias("_prefix"), F.col("id").alias("_id")), "_prefix", "left")
    best = hit.groupBy(path_col, "_anchor", "_segs", "_full", "_b").agg(
        F.max(F.when(F.col("_id").isNotNull(), F.struct("_k", "_id"))).alias("_h"))
    found = F.coalesce(F.col("_h._k"), F.lit(0)) - F.col("_b")
    n = F.size("_segs")
    full = found >= n
    return best.select(
        path_col,
        F.when(n == 0, F.coalesce("_anchor", F.lit("root"))).when(full, F.col("_h._id")).alias("folder_id"),
        F.when(~full & (n > 0), F.array_join(F.slice("_segs", 1, F.greatest(found, F.lit(0)) + 1), "/"))
        .alias("missing_prefix"))


def walk_folders(requests: DataFrame, listing: DataFrame, path_col: str = "path") -> DataFrame:
    """J13 by a walk of the requests themselves: (path, folder_id, missing_prefix).

    All requests start at the root (or at the folder that a leading ``id:<folder>``
    names) and go down one level per round: the distinct (folder, next name) pairs
    are joined with the folders by parent and name, so a prefix that many requests
    share is asked for once, and folders that no request reaches are never expanded.
    A round keeps only the requests that found their folder and go on; the others
    are answered. Of folders with one parent and name the greatest id counts.
    """
    from ratebook.operators.staging import written
    folders = written(listing.where(F.col("item_type") == "folder").groupBy("parent_id", "name").agg(F.max("id").alias("found")), "folders")
    segs = F.filter(F.transform(F.split(F.col(path_col), "/"), lambda s: strip_unicode(s)), lambda s: s != "")
    r = requests.select(path_col).distinct().select("*", F.coalesce(segs, F.array().cast("array<string>")).alias("_segs"))
    first = F.try_element_at("_segs", F.lit(1))
    anchored = F.coalesce(first.startswith("id:") & (F.length(first) > 3), F.lit(False))
    skip = anchored | F.coalesce(first.isin("root", "ROOT"), F.lit(False))
    walking = written(r.select(path_col, F.when(anchored, F.substr(first, F.lit(4))).otherwise(F.lit("root")).alias("_at"),
                               F.when(skip, F.slice("_segs", 2, F.size("_segs"))).otherwise(F.col("_segs")).alias("_segs")), "requests")
    out, depth = None, 0
    while not walking.isEmpty():
        asked = F.get("_segs", F.lit(depth))
        there = walking.where(F.size("_segs") == depth).select(
            path_col, F.col("_at").alias("folder_id"), F.lit(None).cast("string").alias("missing_prefix"))
        on = walking.where(F.size("_segs") > depth).withColumn("_next", asked)
        pairs = on.select("_at", "_next").distinct()
        hits = pairs.join(folders, (F.col("_at") == F.col("parent_id")) & (F.col("_next") == F.col("name"))).select("_at", "_next", "found")
        moved = written(on.join(hits, ["_at", "_next"], "left"), "walk")
        lost = moved.where(F.col("found").isNull()).select(
            path_col, F.lit(None).cast("string").alias("folder_id"), F.array_join(F.slice("_segs", 1, depth + 1), "/").alias("missing_prefix"))
        answers = there.unionByName(lost)
        out = answers if out is None else out.unionByName(answers)
        walking, depth = moved.where(F.col("found").isNotNull()).select(path_col, F.col("found").alias("_at"), "_segs"), depth + 1
    return out if out is not None else walking.select(path_col, F.col("_at").alias("folder_id"), F.col("_at").alias("missing_prefix"))


def split_name(name) -> tuple[Column, Column]:
    """(stem, suffix) split at the last dot; no dot -> (name, '')."""
    n = col_(name)
    has = F.contains(n, F.lit("."))
    stem = F.when(has, F.regexp_extract(n, r"^(.*)\.[^.]*$", 1)).otherwise(n)
    suffix = F.when(has, F.regexp_extract(n, r"(\.[^.]*)$", 1)).otherwise(F.lit(""))
    return stem, suffix


def plan_conflicts(items: DataFrame, listing: DataFrame, clock: str) -> DataFrame:
    """Planned action and final name per work item given the destination listing.

    Name exists: skip -> skipped; overwrite -> uploaded, same name; rename ->
    uploaded as ``<stem>_<yyyyMMdd-HHmmss><ext>`` at ``clock``. Otherwise uploaded.
    """
    existing = listing.where(F.col("item_type") == "file").select(
        F.col("parent_id").alias("folder_id"), F.col("name").alias("requested_name"),
        F.lit(True).alias("_exists")).distinct()
    j = items.join(existing, ["folder_id", "requested_name"], "left")
    exists = F.coalesce(F.col("_exists"), F.lit(False))
    stem, suffix = split_name(F.col("requested_name"))
    stamp = F.date_format(F.lit(clock).cast("timestamp"), "yyyyMMdd-HHmmss")
    renamed = F.concat(stem, F.lit("_"), stamp, suffix)
    status = F.when(exists & (F.col("strategy") == "skip"), F.lit("skipped")).otherwise(F.lit("uploaded"))
    final = F.when(exists & (F.col("strategy") == "rename"), renamed).otherwise(F.col("requested_name"))
    return j.select(*items.columns, status.alias("status"), final.alias("final_name"))


def attempt_outcomes(attempts: DataFrame, max_retries: int = 2) -> DataFrame:
    """A7 per item: the deciding attempt among the attempts in order.

    ``attempts``: batch_id, item, ordinal, status (uploaded/skipped/failed),
    requested_name, final_name, message, error_class, file_path. A failure is
    retried while retryable and attempts <= max_retries; the first attempt that
    ends the loop decides (the last recorded one when the log stops early).
    """
    from ratebook.operators.ordinal import number_rows
    numbered = number_rows(attempts, ["ordinal"], ["batch_id", "item"], out="attempt_no")
    retry = retryable(F.col("message"), F.col("error_class"))
    ends = ((F.col("status") != "failed") | ~retry | (F.col("attempt_no") > max_retries))
    a = numbered.withColumn("_ends", ends)
    packed = F.struct(F.col("attempt_no"), *[F.col(c) for c in attempts.columns if c not in ("batch_id", "item")])
    best = a.groupBy("batch_id", "item").agg(
        F.min(F.when(F.col("_ends"), packed)).alias("_first_end"),
        F.max(packed).alias("_last"),
        F.count(F.lit(1)).alias("_recorded"))
    chosen = F.coalesce(F.col("_first_end"), F.col("_last"))
    out = best.select("batch_id", "item", chosen.alias("_c"))
    cols = [c for c in attempts.columns if c not in ("batch_id", "item")]
    out = out.select("batch_id", "item", F.col("_c.attempt_no").alias("attempts"),
                     *[F.col(f"_c.{c}").alias(c) for c in cols])
    reason = F.when(F.col("status") == "failed",
                    sanitize_reason(F.col("message"), F.col("file_path"),
                                    F.element_at(F.split("file_path", "/"), -1)))
    return out.withColumn("reason", reason)


def batch_report(outcomes: DataFrame) -> DataFrame:
    """A7 per batch: totals by outcome (one aggregate, combined map-side)."""
    renamed = (F.col("status") == "uploaded") & F.col("final_name").isNotNull() & \
        (F.col("final_name") != F.col("requested_name"))
    return outcomes.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "uploaded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(renamed).alias("renamed"),
        F.sum("attempts").alias("attempts"))


def batch_items(outcomes: DataFrame) -> DataFrame:
    """A7 lists: (batch_id, list, position, name, requested, renamed_to, reason, attempts), one row per listed item.

    An item is in the list of its outcome, and in ``renamed`` too if it was stored under another
    name. Positions follow the item; they come from ranges of the whole key, so a batch of any
    size is many tasks, and written as it stands the table is a sorted run per list.
    """
    from ratebook.operators.ordinal import number_rows
    renamed = F.coalesce((F.col("status") == "uploaded") & (F.col("final_name") != F.col("requested_name")), F.lit(False))
    name = F.when(F.col("status") == "uploaded", "success").when(F.col("status") == "failed", "failed").otherwise("skipped")
    lists = F.when(renamed, F.array(name, F.lit("renamed"))).otherwise(F.array(name))
    rows = outcomes.select(
        "batch_id", F.explode(lists).alias("list"), "item", F.coalesce("final_name", "requested_name").alias("name"),
        F.col("requested_name").alias("requested"), F.when(renamed, F.col("final_name")).alias("renamed_to"), "reason", "attempts")
    return number_rows(rows, ["item"], ["batch_id", "list"], out="position").drop("item")


def batch_durations(attempts: DataFrame, at: str = "at") -> DataFrame:
    """A7 duration: per batch its first and last attempt and the seconds between them."""
    span = attempts.groupBy("batch_id").agg(F.min(at).alias("started_at"), F.max(at).alias("ended_at"))
    return span.withColumn("seconds", F.timestamp_diff("SECOND", F.col("started_at"), F.col("ended_at")).cast("bigint"))


def index_rows(spark: SparkSession, files: DataFrame, sha256: Column | None = None) -> DataFrame:
    """S9 + X30: (path, file_name, size, sha256, mime_type, modified_at, parsed) of each row of
    ``files`` (path, content, length, modificationTime); ``sha256`` stands for the content's hash if given."""
    out = files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("size"),
                       (F.sha2("content", 256) if sha256 is None else sha256).alias("sha256"),
                       F.col("modificationTime").alias("modified_at"), F.lit(False).alias("parsed"))
    return with_mime_type(spark, out, "file_name")


def file_index(spark: SparkSession, path_glob: str) -> DataFrame:
    """S9 over stored files: small ones are one row each, large ones are hashed range by range, at once.

    Files the ranges leave out are rows too, of 2 GB at most; Spark's reader fails beyond.
    """
    from ratebook.operators.filehash import ranged_sha256
    files = spark.read.format("binaryFile").load(path_glob)
    hashes = ranged_sha256(spark, path_glob)
    if not hashes:
        return index_rows(spark, files)
    at = F.col("_metadata.file_path")
    known = spark.createDataFrame(sorted(hashes.items()), "at string, sha256 string")
    listed = ("path", "length", "modificationTime")
    rows = files.where(~at.isin(*hashes)).select(*listed, F.sha2("content", 256).alias("sha256")).unionByName(
        files.where(at.isin(*hashes)).select(*listed, at.alias("at")).join(known, "at").drop("at"))
    return index_rows(spark, rows, F.col("sha256"))


def prefix_rows(files: DataFrame, n: int = 8192) -> DataFrame:
    """sha256 of the first ``n`` bytes of each row's content."""
    return files.select("path", F.sha2(F.substring("content", 1, n), 256).alias("prefix_sha256"),
                        F.least(F.col("length"), F.lit(n).cast("bigint")).alias("sampled_bytes"))


def prefix_hash(spark: SparkSession, path_glob: str, n: int = 8192) -> DataFrame:
    """X27 over stored files."""
    return prefix_rows(spark.read.format("binaryFile").load(path_glob), n)


def mime_table(spark: SparkSession) -> DataFrame:
    """Extension -> MIME type: Python's built-in table, without the files of this machine."""
    rows = sorted({(ext.lstrip(".").lower(), typ) for ext, typ in mimetypes.MimeTypes().types_map[True].items()})
    return spark.createDataFrame(rows, "ext string, mime_type string")


def with_mime_type(spark: SparkSession, df: DataFrame, name_col: str) -> DataFrame:
    """MIME type by extension, default ``application/octet-stream``.

    A short form such as ``.tgz`` stands for ``.tar.gz``, and one compression
    suffix is left out before the type is looked up.
    """
    fixed = mimetypes.MimeTypes()
    ext = F.regexp_extract(F.col(name_col), r"(\.[^./]+)$", 1)
    short = F.create_map(*[F.lit(x) for pair in fixed.suffix_map.items() for x in pair])
    long = F.concat(F.substr(F.col(name_col), F.lit(1), F.length(name_col) - F.length(ext)), F.coalesce(short[ext], ext))
    suffix = F.regexp_extract(long, r"(\.[^./]+)$", 1)
    plain = F.when(suffix.isin(*fixed.encodings_map), F.regexp_replace(long, r"\.[^./]+$", "")).otherwise(long)
    m = mime_table(spark)
    return (df.withColumn("_ext", F.lower(F.regexp_extract(plain, r"\.([^./]+)$", 1))).join(m, F.col("_ext") == m["ext"], "left")
            .withColumn("mime_type", F.coalesce(F.col("mime_type"), F.lit("application/octet-stream")))
            .drop("_ext", "ext"))


def verify_sizes(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Listed size (file_name, listed_size) vs bytes there (file_name, actual_size); a mismatch
    is an error (no listed size passes)."""
    j = manifest.join(files, "file_name", "left")
    ok = F.col("listed_size").isNull() | F.col("listed_size").eqNullSafe(F.col("actual_size"))
    return j.withColumn("error", F.when(~ok, F.concat(F.lit("size mismatch: expected "),
                                                       F.col("listed_size").cast("string"), F.lit(", got "),
                                                       F.coalesce(F.col("actual_size").cast("string"), F.lit("none")))))


def download_verify(manifest: DataFrame, spark: SparkSession, path_glob: str) -> DataFrame:
    """J12 over stored files: the listing against the sizes the file system gives."""
    files = spark.read.format("binaryFile").load(path_glob).select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("actual_size"))
    return verify_sizes(manifest, files)


__all__ = ["parse_listing", "validate_path", "normalize_parent_id", "normalize_item_name", "join_drive_path",
           "folder_paths", "resolve_folders", "walk_folders", "plan_conflicts", "attempt_outcomes", "batch_report", "batch_items",
           "batch_durations", "file_index",
           "index_rows", "prefix_rows", "verify_sizes", "prefix_hash", "with_mime_type", "download_verify", "mask_filename"]
