"""Filters, projections, scalar expressions, deduplication and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import dedup, filters
from ..operators.filters import Condition as C
from ..plans.fixtures import AS_OF_NS, Tables
from ..sources import io
from . import query

DAY = fn.DAY_NS


@query("entries", sql="SELECT k, relative_path FROM entries WHERE is_symlink")
def flt_type(t: Tables):
    return filters.by_groups(t("entries"), [[C("type", "==", "symlink")]], AS_OF_NS).select("k", "relative_path")


@query("work", sql="SELECT k, size FROM work WHERE size >= 100000000")
def flt_size(t: Tables):
    return filters.by_groups(t("work"), [[C("size", ">=", 100000000)]], AS_OF_NS).select("k", "size")


@query("work", sql=f"SELECT k FROM work WHERE mtime_ns > {AS_OF_NS} - 90.5*{DAY}")
def flt_modified_rel(t: Tables):
    return filters.by_groups(t("work"), [[C("modified", "<", "90.5d")]], AS_OF_NS).select("k")


@query("work", sql="SELECT k FROM work WHERE mtime_ns < epoch_us(TIMESTAMP '1995-01-15')*1000")
def flt_modified_abs(t: Tables):
    return filters.by_groups(t("work"), [[C("modified", "<", "1995-01-15")]], AS_OF_NS).select("k")


@query("work", sql="SELECT k FROM work WHERE regexp_full_match(string_split(relative_path,'/')[-1], 'order_[^/]?[1-3][^/]*\\.[ct][^/]*')")
def flt_name_glob(t: Tables):
    return filters.by_groups(t("work"), [[C("name", "==", "order_?[1-3]*.[ct]*")], [C("name", "==", "order_[1-3]*.[ct]*")]], AS_OF_NS).select("k")


@query("work", sql="SELECT k FROM work WHERE regexp_full_match(relative_path, '([^/]+/)*199[0-5]/[^/]*/[^/]*\\.log')")
def flt_path_glob(t: Tables):
    return filters.by_groups(t("work"), [[C("path", "==", "**/199[0-5]/*/*.log")]], AS_OF_NS).select("k")


@query("work", sql="SELECT k, ext FROM work WHERE lower(ext) = 'parquet'")
def flt_extension(t: Tables):
    return filters.by_groups(t("work"), [[C("extension", "==", "PARQUET")]], AS_OF_NS).select("k", "ext")


@query("work", sql="SELECT k FROM work WHERE regexp_matches(relative_path, '/1[0-2]/') AND NOT regexp_matches(relative_path, 'log$')")
def flt_regex(t: Tables):
    return filters.by_groups(t("work"), [[C("regex", "=~", "/1[0-2]/"), C("regex", "!~", "log$")]], AS_OF_NS).select("k")


_DATED = """d AS (SELECT k, CASE k%6 WHEN 0 THEN concat('in-', CAST(1990+k%9 AS STRING), '-0', CAST(1+k%9 AS STRING), '-', CAST(10+k%25 AS STRING), 'x') WHEN 1 THEN concat('a', CAST(1990+k%9 AS STRING), '1', CAST(k%4 AS STRING), CAST(10+k%25 AS STRING)) WHEN 2 THEN concat('z9', CAST(10+k%9 AS STRING), '0', CAST(1+k%9 AS STRING), CAST(10+k%30 AS STRING)) ELSE concat('plain', CAST(k AS STRING)) END AS dir FROM work)"""


@query("work", sql=_DATED + """, o AS (SELECT k, dir, unnest(range(1, length(dir)+1)) AS i FROM d)
SELECT DISTINCT k, dir FROM o WHERE (regexp_full_match(substr(dir,i,10), '\\d{4}-\\d{2}-\\d{2}') AND try_strptime(substr(dir,i,10),'%Y-%m-%d') IS NOT NULL)
 OR (regexp_full_match(substr(dir,i,8), '\\d{8}') AND try_strptime(substr(dir,i,8),'%Y%m%d') IS NOT NULL) OR (regexp_full_match(substr(dir,i,6), '\\d{6}') AND try_strptime('20' || substr(dir,i,6),'%Y%m%d') IS NOT NULL)""")  # fmt: skip
def flt_dir_date(t: Tables):
    df = t.spark.sql(_DATED.removeprefix("d AS (").removesuffix(")").replace("FROM work", "FROM {work}"), work=t("work"))
    return df.where(filters.has_date(F.col("dir"))).select("k", "dir")


@query("entries", sql="SELECT k FROM entries WHERE (is_regular_file AND size < 5000) OR (lower(ext)='csv' AND size > 200000000)")
def flt_groups(t: Tables):
    groups = [[C("type", "==", "file"), C("size", "<", 5000), C("name", None, None)], [C("extension", "==", "csv"), C("size", ">", 200000000)], []]
    return filters.by_groups(t("entries"), groups, AS_OF_NS).select("k")


_TREE = """x AS (SELECT k, relative_path, is_dir FROM entries UNION ALL SELECT DISTINCT -1, regexp_replace(relative_path,'/[^/]*$',''), TRUE FROM entries)"""


def _with_dirs(t: Tables):
    e = t("entries").select("k", "relative_path", "is_dir")
    return e.unionAll(e.select(F.lit(-1).cast("long"), fn.parent("relative_path"), F.lit(True)).distinct())


@query("entries", sql=_TREE + ", m AS (SELECT relative_path FROM x WHERE is_dir AND regexp_full_match(relative_path,'[^/]*/1996/[1-3]')) SELECT k, relative_path FROM x WHERE relative_path IN (SELECT relative_path FROM m) OR EXISTS (SELECT 1 FROM m WHERE starts_with(x.relative_path, m.relative_path || '/'))")
def flt_match_subtree(t: Tables):
    return filters.match_subtree(_with_dirs(t), F.col("relative_path").rlike(fn.glob_to_regex("*/1996/[1-3]", True))).select("k", "relative_path")


@query("entries", sql=_TREE + ", m AS (SELECT relative_path FROM x WHERE regexp_full_match(relative_path,'[^/]*/199[0-5]/[^/]*')) SELECT k, relative_path FROM x WHERE relative_path NOT IN (SELECT relative_path FROM m) AND NOT EXISTS (SELECT 1 FROM m WHERE starts_with(x.relative_path, m.relative_path || '/'))")
def flt_exclude_subtree(t: Tables):
    return filters.exclude_subtree(_with_dirs(t), F.col("relative_path").rlike(fn.glob_to_regex("*/199[0-5]/*", True))).select("k", "relative_path")


@query("work", sql="SELECT k FROM work WHERE len(string_split(relative_path,'/')) <= 4")
def flt_depth(t: Tables):
    return filters.to_depth(t("work"), 4).select("k")


@query("entries", sql="SELECT k FROM entries WHERE NOT is_dir AND relative_path ILIKE '%.parquet' AND confirmed")
def flt_catalogue(t: Tables):
    return filters.catalogue(t("entries"), is_dir=False, suffix=".PARQUET").select("k")


@query("entries", sql="SELECT k FROM entries WHERE job_id=2 AND generation=0 AND NOT is_deleted")
def flt_scope(t: Tables):
    return filters.scope(t("entries"), 2, 0).select("k")


@query("acl", sql="SELECT path, trustees FROM (SELECT path, any_value(inheritance) AS inh, bool_or(NOT inherited) AS expl, string_agg(trustee, ',' ORDER BY trustee) FILTER (WHERE contains(trustee,'A') AND NOT inherited) AS trustees FROM acl GROUP BY path) WHERE (expl OR NOT inh) AND trustees IS NOT NULL")
def flt_acl_owner(t: Tables):
    aces = t("acl").groupBy("path").agg(F.first("inheritance").alias("inheritance"), F.collect_list(F.struct("trustee", "inherited")).alias("aces"))
    return filters.acl_owner(aces, "A").select("path", F.array_join(F.array_sort(F.transform("aces", lambda a: a["trustee"])), ",").alias("trustees"))


@query("work_x", sql="SELECT " + ", ".join(filters.SUMMARY_COLUMNS) + " FROM (SELECT * FROM work_x)")
def prj_summary(t: Tables):
    return filters.summary(t("work_x"))


@query("entries", sql="SELECT k, CASE WHEN storage_type='s3' THEN replace(relative_path,'/','\\') ELSE relative_path END AS path FROM entries")
def prj_relative_path_norm(t: Tables):
    df = t("entries").select("k", "storage_type", F.translate("relative_path", "/", "\\").alias("relative_path"))
    return df.select("k", filters.normalised_path().alias("path"))


_ODD = "CASE k%7 WHEN 0 THEN concat('/',relative_path) WHEN 1 THEN concat('a/../',relative_path) WHEN 2 THEN concat(relative_path,'/') WHEN 3 THEN concat('a//',relative_path) WHEN 4 THEN concat('./',relative_path) ELSE relative_path END"


@query("work", sql=f"SELECT k, p FROM (SELECT k, {_ODD} AS p FROM work) WHERE NOT (starts_with(p,'/') OR list_has_any(string_split(regexp_replace(p,'/$',''),'/'), ['','.','..']))")
def prj_safe_tree_path(t: Tables):
    df = t("work").select("k", F.expr(_ODD).alias("p"))
    return df.where(filters.safe_path_column("p"))


@query("base_x", "work_x", sql="SELECT w.k, w.mode IS NOT DISTINCT FROM b.mode AS same_mode FROM work_x w JOIN base_x b ON w.k=b.k")
def fn_null_eq(t: Tables):
    return t("work_x").alias("w").join(t("base_x").alias("b"), "k").select("k", fn.null_eq("w.mode", "b.mode").alias("same_mode"))


@query("work", sql="SELECT k, CAST(len(string_split(relative_path,'/')) AS INTEGER) AS depth FROM work")
def fn_depth(t: Tables):
    return t("work").select("k", fn.depth("relative_path").alias("depth"))


@query("work", sql="SELECT k, string_split(relative_path,'/')[-1] AS name FROM work")
def fn_name(t: Tables):
    return t("work").select("k", fn.name("relative_path").alias("name"))


@query("work", sql="SELECT k, regexp_replace(relative_path,'/[^/]*$','') AS parent FROM work")
def fn_parent(t: Tables):
    return t("work").select("k", fn.parent("relative_path").alias("parent"))


_NAMES = "CASE k%6 WHEN 0 THEN '.bashrc' WHEN 1 THEN 'a.tar.gz' WHEN 2 THEN 'x.' ELSE relative_path END"


@query("work", sql=f"SELECT k, CASE WHEN regexp_full_match(n, '.+\\.[^.]*') THEN regexp_extract(n, '\\.([^.]*)$', 1) END AS ext FROM (SELECT k, string_split({_NAMES},'/')[-1] AS n FROM work)")
def fn_ext(t: Tables):
    return t("work").select("k", fn.ext(F.expr(_NAMES)).alias("ext"))


@query("url_tree", sql="p AS (SELECT k, string_split(relative_path,'/') AS s FROM url_tree), q AS (SELECT k, s, unnest(range(1, len(s))) AS i FROM p) SELECT k, array_to_string(list_slice(s,1,i),'/') AS dir FROM q")
def fn_ancestors(t: Tables):
    return t("url_tree").select("k", F.explode(fn.ancestors("relative_path")).alias("dir"))


def _sql_bucket(value: str, bounds) -> str:
    return "CASE " + " ".join(f"WHEN {value} < {b} THEN {i}" for i, b in enumerate(bounds)) + f" ELSE {len(bounds)} END"


def _sql_label(bucket: str, labels) -> str:
    return f"CASE {bucket} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(labels)) + " END"


SIZE_SQL = _sql_bucket("size", fn.SIZE_BOUNDS)
AGE_SQL = _sql_bucket(f"({AS_OF_NS}-mtime_ns)", [d * DAY for d in fn.AGE_DAYS])


@query("work", sql=f"SELECT k, bucket, {_sql_label('bucket', fn.SIZE_LABELS)} AS label FROM (SELECT k, {SIZE_SQL} AS bucket FROM work)")
def fn_size_bucket(t: Tables):
    return t("work").select("k", fn.size_bucket("size").alias("bucket")).withColumn("label", fn.label("bucket", fn.SIZE_LABELS))


@query("work", sql=f"SELECT k, bucket, {_sql_label('bucket', fn.AGE_LABELS)} AS label FROM (SELECT k, {AGE_SQL} AS bucket FROM work)")
def fn_age_bucket(t: Tables):
    return t("work").select("k", fn.age_bucket("mtime_ns", AS_OF_NS).alias("bucket")).withColumn("label", fn.label("bucket", fn.AGE_LABELS))


@query("work", sql=f"SELECT k, CASE WHEN m IS NULL THEN 5 ELSE {_sql_bucket(f'({AS_OF_NS}-m)', [d * DAY for d in fn.AGE_DAYS_UI])} END AS bucket FROM (SELECT k, CASE WHEN k%9<>0 THEN mtime_ns END AS m FROM work)")
def fn_age_bucket_ui(t: Tables):
    return t("work").select("k", fn.age_bucket_ui(F.when(F.col("k") % 9 != 0, F.col("mtime_ns")), AS_OF_NS).alias("bucket"))


@query("work", sql="SELECT k, CASE WHEN s<1024 THEN printf('%.2f B', s) WHEN s<1024.0**2 THEN printf('%.2f KiB', s/1024) WHEN s<1024.0**3 THEN printf('%.2f MiB', s/1024.0**2) WHEN s<1024.0**4 THEN printf('%.2f GiB', s/1024.0**3) ELSE printf('%.2f TiB', s/1024.0**4) END AS shown FROM (SELECT k, CAST(size*(1+k%5000) AS DOUBLE) AS s FROM work)")
def fn_format_bytes(t: Tables):
    return t("work").select("k", fn.format_bytes(F.col("size") * (1 + F.col("k") % 5000)).alias("shown"))


@query("work", sql="SELECT k, CASE WHEN h>0 THEN concat(h,'h',m,'m',s,'s') WHEN m>0 THEN concat(m,'m',s,'s') ELSE concat(s,'s') END AS shown FROM (SELECT k, k//3600 AS h, (k%3600)//60 AS m, k%60 AS s FROM work)")
def fn_format_elapsed(t: Tables):
    return t("work").select("k", fn.format_elapsed("k").alias("shown"))


_SIZES = "concat(CAST(k%97 AS STRING), CASE k%9 WHEN 0 THEN '' WHEN 1 THEN ' KB' WHEN 2 THEN 'MiB' WHEN 3 THEN '.5 gib' WHEN 4 THEN 'tb' WHEN 5 THEN 'GiB/s' WHEN 6 THEN '.25mb' WHEN 7 THEN 'kib' ELSE ' x' END)"


@query("work", sql=f"SELECT k, CASE WHEN regexp_full_match(v,'[0-9]+') THEN CAST(v AS BIGINT) WHEN regexp_full_match(v,'[0-9.]+[kmg]i?b') THEN CAST(round(CAST(regexp_extract(v,'^[0-9.]+') AS DOUBLE)*CASE regexp_extract(v,'([kmg])i?b$',1) WHEN 'k' THEN 1024 WHEN 'm' THEN 1048576 ELSE 1073741824 END) AS BIGINT) END AS bytes FROM (SELECT k, lower(replace({_SIZES},' ','')) AS v FROM work)")
def fn_parse_size(t: Tables):
    return t("work").select("k", fn.parse_size(F.expr(_SIZES)).alias("bytes"))


@query("work", sql="SELECT k, CASE WHEN k%5=1 THEN 'unsupported' ELSE sha256('tags:' || '1:a' || CAST(strlen(CAST(k%7 AS STRING)) AS STRING) || ':' || CAST(k%7 AS STRING) || '1:b' || CAST(strlen(coalesce(ext,'-')) AS STRING) || ':' || coalesce(ext,'-')) END AS digest FROM work")
def fn_metadata_digest(t: Tables):
    tags = F.create_map(F.lit("b"), F.coalesce("ext", F.lit("-")), F.lit("a"), (F.col("k") % 7).cast("string"))
    df = t("work").select("k", tags.alias("tags"), F.when(F.col("k") % 5 == 1, "unsupported").otherwise("ok").alias("state"))
    return df.select("k", fn.metadata_digest(F.col("tags")).alias("digest"))


@query("work", sql="SELECT k, sha256(concat('{\"relative_path\":\"', relative_path, '\",\"size\":', size, ',\"mode\":', coalesce(CAST(mode AS STRING),'null'), ',\"ext\":', CASE WHEN ext IS NULL THEN 'null' ELSE '\"' || ext || '\"' END, '}')) AS h FROM work")
def fn_entry_hash(t: Tables):
    return t("work").select("k", fn.entry_hash(("relative_path", "size", "mode", "ext")).alias("h"))


@query("work_x", sql="SELECT k, sha256(concat('{\"f0\":\"', identity_key, '\",\"f1\":', mtime_ns, ',\"f2\":\"', metadata_digest, '\"}')) AS marker FROM work_x WHERE marker_state IS NOT NULL")
def fn_marker_state(t: Tables):
    return t("work_x").where("marker_state is not null").select("k", fn.digest_of("identity_key", "mtime_ns", "metadata_digest").alias("marker"))


@query("copy_runs", sql="SELECT execution_id, sha256(concat('{\"f0\":\"', binding, '\",\"f1\":\"', selection_key, '\",\"f2\":', CASE WHEN filtered THEN 'true' ELSE 'false' END, '}')) AS request_key FROM copy_runs")
def fn_request_key(t: Tables):
    return t("copy_runs").select("execution_id", fn.digest_of("binding", "selection_key", "filtered").alias("request_key"))


@query("copy_runs", sql="SELECT execution_id, sha256(concat('{\"f0\":\"', selection_key, '\",\"f1\":', CASE WHEN relative_time THEN 'true' ELSE 'false' END, '}')) AS selection FROM copy_runs")
def fn_selection_key(t: Tables):
    return t("copy_runs").select("execution_id", fn.digest_of("selection_key", "relative_time").alias("selection"))


@query("notifications", sql="SELECT id, sha256(concat('{\"f0\":\"', round_id, '\",\"f1\":\"', attempt_id, '\",\"f2\":', sequence, ',\"f3\":', kind, '}')) AS content_id FROM notifications")
def fn_notification_id(t: Tables):
    return t("notifications").select("id", fn.digest_of("round_id", "attempt_id", "sequence", "kind").alias("content_id"))


@query("notifications", sql="SELECT id, coalesce(strlen(i) BETWEEN 1 AND 256 AND sequence-10>0 AND kind IN (1,2) AND delivery_revision<=1 AND json_valid(p), FALSE) AS valid FROM (SELECT *, CASE WHEN sequence%17=0 THEN '' ELSE id END AS i, CASE WHEN sequence%5=0 THEN '{bad' ELSE payload_json END AS p FROM notifications)")
def fn_valid_notification(t: Tables):
    df = t("notifications").select("id", F.when(F.col("sequence") % 17 == 0, "").otherwise(F.col("id")).alias("i"), (F.col("sequence") - 10).alias("s"), "kind", "delivery_revision", F.when(F.col("sequence") % 5 == 0, "{bad").otherwise(F.col("payload_json")).alias("p"))
    return df.select("id", fn.valid_notification("i", "s", "kind", "delivery_revision", "p").alias("valid"))


@query("logs", sql="SELECT line, CASE line%3 WHEN 0 THEN concat('open [redacted] failed ',level) WHEN 1 THEN 'user u [redacted]' ELSE regexp_replace(trim(message),'\\s+',' ','g') END AS safe FROM logs")
def fn_redact(t: Tables):
    text = F.when(F.col("line") % 3 == 0, F.concat(F.lit("open s3://u:p@h/"), F.col("path"), F.lit("  failed "), F.col("level"))).when(F.col("line") % 3 == 1, F.concat(F.lit("user u Password=x "), F.col("message"))).otherwise(F.col("message"))
    return t("logs").select("line", fn.redact(text).alias("safe"))


@query("base_x", "work_x", sql="SELECT w.k, CASE WHEN d AND m THEN 'both_changed' WHEN d THEN 'data_changed' WHEN m THEN 'metadata_changed' END AS change FROM (SELECT w.k, w.size IS DISTINCT FROM b.size OR w.mtime_ns IS DISTINCT FROM b.mtime_ns AS d, w.mode IS DISTINCT FROM b.mode OR w.uid IS DISTINCT FROM b.uid OR w.gid IS DISTINCT FROM b.gid AS m FROM work_x w JOIN base_x b ON w.k=b.k) w")
def fn_change_kind(t: Tables):
    return t("base_x").alias("o").join(t("work_x").alias("n"), "k").select("k", fn.change_kind().alias("change"))


@query("work", sql="SELECT k, CAST(greatest(700, least(131072, floor(sqrt(size)))) AS BIGINT) AS block_size FROM work")
def fn_block_size(t: Tables):
    return t("work").select("k", fn.block_size("size").cast("long").alias("block_size"))


@query("work", sql="b AS (SELECT k, unnest(range(1, length(relative_path)+1)) AS i, relative_path AS p FROM work), s AS (SELECT k, sum(ascii(substr(p,i,1))) AS a, sum((length(p)-i+1)*ascii(substr(p,i,1))) AS b FROM b GROUP BY k) SELECT k, CAST((b%65521)*65536 + a%65521 AS BIGINT) AS weak FROM s")
def fn_weak_hash(t: Tables):
    return t("work").select("k", fn.weak_hash("relative_path").alias("weak"))


@query("work", sql="SELECT k, concat('[{\"key\":\"ext\",\"value\":\"', coalesce(ext,'-'), '\"},{\"key\":\"uid\",\"value\":\"', uid, '\"}]') AS tags FROM work")
def fn_tags_json(t: Tables):
    listed = F.concat(F.lit('[{"key":"uid","value":"'), F.col("uid").cast("string"), F.lit('"},{"key":"ext","value":"'), F.coalesce("ext", F.lit("-")), F.lit('"}]'))
    mapped = F.concat(F.lit('{"uid":"'), F.col("uid").cast("string"), F.lit('","ext":"'), F.coalesce("ext", F.lit("-")), F.lit('"}'))
    return t("work").select("k", fn.tags_to_json(fn.tags_from_json(F.when(F.col("k") % 2 == 0, listed).otherwise(mapped))).alias("tags"))


_UNION = "u AS (SELECT relative_path, version_id, size, copy_sequence, k FROM base_x UNION ALL SELECT relative_path, version_id, size, copy_sequence, k FROM work_x)"


def _both(t: Tables):
    cols = ["relative_path", "version_id", "size", "copy_sequence", "k"]
    return t("base_x").select(*cols).unionByName(t("work_x").select(*cols))


@query("base_x", "work_x", sql=_UNION + " SELECT relative_path, version_id, size, copy_sequence, k FROM u QUALIFY row_number() OVER (PARTITION BY relative_path, version_id ORDER BY copy_sequence DESC)=1")
def dd_latest_by_key(t: Tables):
    return dedup.latest_by_key(_both(t), ["relative_path", "version_id"], "copy_sequence")


@query("base_x", "work_x", sql="SELECT b.relative_path, b.size FROM base_x b WHERE NOT EXISTS (SELECT 1 FROM work_x w WHERE w.relative_path=b.relative_path AND w.k%3=0)")
def dd_tombstone(t: Tables):
    keys = ["relative_path", "version_id"]
    return dedup.with_tombstones(t("base_x").select(*keys, "size", "copy_sequence"), t("work_x").where("k%3=0").select(*keys, "copy_sequence"), keys, "copy_sequence").select("relative_path", "size")


@query("base_x", sql="SELECT uid, relative_path, size FROM base_x QUALIFY row_number() OVER (PARTITION BY uid ORDER BY size DESC, relative_path)=1")
def dd_limit_by(t: Tables):
    return dedup.limit_by(t("base_x"), ["uid"], [F.desc("size"), "relative_path"]).select("uid", "relative_path", "size")


@query("events_replayed", sql="SELECT path, count(*) AS rows, CASE WHEN min(o)=max(o) THEN min(o) ELSE 'conflict' END AS result FROM (SELECT path, op AS o FROM events_replayed UNION ALL SELECT path, 'new' FROM events_replayed WHERE event_id%7=0) GROUP BY path")
def dd_same_or_conflict(t: Tables):
    e = t("events_replayed").select("path", F.col("op").alias("o"), "event_id")
    return dedup.conflicts(e.select("path", "o").unionAll(e.where("event_id%7=0").select("path", F.lit("new"))), ["path"], "o")


@query("versions", sql="SELECT relative_path, '' AS version_id, size FROM versions WHERE is_latest")
def dd_latest_versions(t: Tables):
    return dedup.latest_versions(t("versions")).select("relative_path", "version_id", "size")


@query("base_x", "work_x", sql="SELECT relative_path FROM work_x UNION ALL SELECT relative_path FROM base_x")
def set_union_all(t: Tables):
    return t("work_x").select("relative_path").unionByName(t("base_x").select("relative_path"))


@query("base_x", "work_x", sql="SELECT relative_path, size FROM (SELECT relative_path, size, copy_sequence FROM base_x UNION ALL SELECT relative_path, size, copy_sequence FROM work_x) QUALIFY row_number() OVER (PARTITION BY relative_path ORDER BY copy_sequence DESC)=1")
def set_union_merge(t: Tables):
    return dedup.latest_by_key(_both(t), ["relative_path", "version_id"], "copy_sequence").select("relative_path", "size")


@query("base", "work", sql="SELECT relative_path FROM base EXCEPT SELECT relative_path FROM work")
def set_except(t: Tables):
    return t("base").select("relative_path").exceptAll(t("work").select("relative_path")).distinct()


@query("base", "work", sql="SELECT relative_path FROM base INTERSECT SELECT relative_path FROM work")
def set_intersect(t: Tables):
    return t("base").select("relative_path").intersect(t("work").select("relative_path"))


@query("events_replayed", sql="SELECT DISTINCT round, op, path FROM events_replayed")
def set_distinct(t: Tables):
    return t("events_replayed").select("round", "op", "path").distinct()


@query("base_x", "work_x", sql="SELECT relative_path, version_id, file_handle, side FROM (SELECT relative_path, version_id, file_handle, 0 AS p, 'old' AS side FROM base_x UNION ALL SELECT relative_path, version_id, file_handle, 1, 'displaced' FROM work_x) QUALIFY row_number() OVER (PARTITION BY relative_path, version_id, file_handle ORDER BY p)=1")
def set_dedup_first(t: Tables):
    keys = ["relative_path", "version_id", "file_handle"]
    parts = [t("base_x").select(*keys, F.lit("old").alias("side")), t("work_x").select(*keys, F.lit("displaced").alias("side"))]
    return dedup.dedup_first(parts, keys, [])


@query("work", sql="SELECT k, relative_path, string_split(relative_path,'/')[-1] AS name, ext, size, 'file' AS entry_kind FROM work")
def src_listing(t: Tables):
    raw = t("work").select("k", F.concat(F.lit("/"), F.translate("relative_path", "/", "\\")).alias("path"), "size", "mtime_ns", F.lit(False).alias("is_dir"), F.lit(False).alias("is_symlink"))
    return io.listing(raw).join(t("work").select("k", "relative_path"), "relative_path").select("k", "relative_path", "name", "ext", "size", "entry_kind")

