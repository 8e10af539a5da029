"""Comparison, rename, merge, integrity and plan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, integrity
from ..plans.fixtures import Tables
from . import query

KEY = "relative_path, version_id"


@query("base_x", "work_x", sql="SELECT k, relative_path FROM work_x w WHERE NOT EXISTS (SELECT 1 FROM base_x b WHERE b.confirmed AND b.relative_path=w.relative_path)")
def cmp_new_path(t: Tables):
    return compare.new_by_path(t("work_x"), t("base_x")).select("k", "relative_path")


@query("base_x", "work_x", sql="SELECT k, relative_path FROM work_x w WHERE NOT EXISTS (SELECT 1 FROM base_x b WHERE b.confirmed AND b.relative_path=w.relative_path AND b.entry_kind=w.entry_kind AND coalesce(b.file_handle,'')=coalesce(w.file_handle,''))")
def cmp_new_copypath(t: Tables):
    return compare.new_by_copy_path(t("work_x"), t("base_x")).select("k", "relative_path")


@query("base_x", "work_x", sql="""c AS (SELECT * FROM base_x WHERE confirmed)
SELECT w.k, w.relative_path FROM work_x w LEFT JOIN c ON c.relative_path=w.relative_path LEFT JOIN (SELECT DISTINCT file_handle AS h FROM c WHERE file_handle IS NOT NULL) x ON x.h=w.file_handle
WHERE CASE WHEN w.file_handle IS NULL THEN c.k IS NULL OR c.file_handle IS NOT NULL ELSE x.h IS NULL OR (c.k IS NOT NULL AND w.file_handle IS DISTINCT FROM c.file_handle) END""")  # fmt: skip
def cmp_new_handle(t: Tables):
    return compare.new_by_handle(t("work_x"), t("base_x")).select("k", "relative_path")


_DATA = "((NOT w.is_dir AND (w.size<>b.size OR w.mtime_ns<>b.mtime_ns{copy})) OR w.marker_state IS DISTINCT FROM b.marker_state)"
_META = "(w.mode IS DISTINCT FROM b.mode OR w.uid IS DISTINCT FROM b.uid OR w.gid IS DISTINCT FROM b.gid OR w.metadata_digest<>b.metadata_digest OR (w.is_dir AND w.mtime_ns<>b.mtime_ns){copy})"


def _change(mode: str) -> str:
    d = _DATA.format(copy=" OR w.source_version_id<>b.source_version_id OR w.identity_key<>b.identity_key" if mode == "copy" else "")
    m = _META.format(copy=" OR NOT b.copy_path_confirmed" if mode == "copy" else "")
    return f"CASE WHEN w.is_dir AND w.marker_state IS NULL AND b.marker_state IS NOT NULL THEN 'directory_marker_removed' WHEN {d} AND {m} THEN 'both_changed' WHEN {d} THEN 'data_changed' WHEN {m} THEN 'metadata_changed' END"


@query("base_x", "work_x", sql=f"SELECT * FROM (SELECT w.k, w.relative_path, {_change('copy')} AS change FROM work_x w JOIN base_x b ON b.relative_path=w.relative_path AND b.confirmed) WHERE change IS NOT NULL")
def cmp_changed(t: Tables):
    return compare.changed(t("work_x"), t("base_x")).select("k", "relative_path", "change")


_CLASSIFY = f"SELECT w.k, w.size, w.is_dir, w.is_symlink, w.is_regular_file, CASE WHEN b.k IS NULL OR w.file_handle IS DISTINCT FROM b.file_handle OR w.entry_kind<>b.entry_kind THEN 'new' ELSE coalesce({_change('copy')},'unchanged') END AS change FROM work_x w LEFT JOIN base_x b ON b.relative_path=w.relative_path AND b.confirmed"


@query("base_x", "work_x", sql=f"SELECT k, size, change FROM ({_CLASSIFY})")
def cmp_classify(t: Tables):
    return compare.classify(t("work_x"), t("base_x")).select("k", "size", "change")


@query("base_x", "work_x", sql="SELECT w.k, CASE WHEN w.is_dir AND w.marker_state IS NULL AND b.marker_state IS NOT NULL THEN 'directory_marker_removed' ELSE 'new' END AS change FROM work_x w LEFT JOIN base_x b ON b.relative_path=w.relative_path AND b.confirmed")
def cmp_force_copy(t: Tables):
    return compare.force_copy(t("work_x"), t("base_x")).select("k", "change")


@query("base_x", "work_x", sql="SELECT CASE WHEN s.h AND b.h AND NOT s.l AND NOT b.l THEN 'handle' ELSE 'path' END AS strategy, s.h AS stage_has, b.h AS base_has, s.l AS stage_legacy, b.l AS base_legacy FROM (SELECT bool_or(file_handle IS NOT NULL) AS h, bool_or(file_handle IS NOT NULL AND NOT starts_with(file_handle,'54534934')) AS l FROM work_x) s, (SELECT bool_or(file_handle IS NOT NULL) AS h, bool_or(file_handle IS NOT NULL AND NOT starts_with(file_handle,'54534934')) AS l FROM base_x WHERE confirmed) b")
def cmp_strategy(t: Tables):
    return compare.strategy(t("work_x"), t("base_x"))


_SCAN = f"SELECT w.k, CASE WHEN (b.k IS NULL OR w.file_handle IS DISTINCT FROM b.file_handle) AND w.file_handle IS NOT NULL THEN 'candidate' WHEN b.k IS NULL THEN 'new' ELSE coalesce({_change('scan')},'unchanged') END AS event, b.k IS NOT NULL AND w.file_handle IS DISTINCT FROM b.file_handle AND b.file_handle IS NOT NULL AS displaced FROM work_x w LEFT JOIN base_x b ON b.relative_path=w.relative_path"


@query("base_x", "work_x", sql=_SCAN)
def cmp_scan(t: Tables):
    return compare.scan_compare(t("work_x"), t("base_x")).select("k", "event", "displaced")


@query("base_v", "work_v", sql="SELECT b.relative_path, b.version_id, b.file_handle FROM base_v b JOIN work_v w ON w.relative_path=b.relative_path AND w.version_id=b.version_id AND w.file_handle IS NOT NULL WHERE b.file_handle IS NOT NULL GROUP BY 1,2,3 HAVING max(CASE WHEN b.file_handle=w.file_handle THEN 1 ELSE 0 END)=0")
def cmp_identity_changed(t: Tables):
    return compare.identity_changed(t("base_v"), t("work_v"))


def _rename(old: str, live: str, log: str) -> str:
    return f"""g AS (SELECT o.* FROM {old} o LEFT JOIN {live} l ON l.relative_path=o.relative_path AND l.version_id=o.version_id WHERE l.relative_path IS NULL OR l.file_handle<>o.file_handle),
cd AS (SELECT l.* FROM {live} l LEFT JOIN {old} o ON l.relative_path=o.relative_path AND l.version_id=o.version_id WHERE o.relative_path IS NULL OR (l.file_handle IS NOT NULL AND l.file_handle IS DISTINCT FROM o.file_handle)),
og AS (SELECT file_handle, relative_path, version_id FROM g WHERE file_handle IS NOT NULL UNION SELECT file_handle, CASE WHEN operation_type='rename' THEN comment ELSE relative_path END, version_id FROM {log} WHERE operation_type<>'new' AND file_handle IS NOT NULL),
oc AS (SELECT file_handle, count(*) AS n, min(relative_path) AS p, min(version_id) AS v FROM og GROUP BY 1), a AS (SELECT file_handle, count(*) AS n FROM {live} WHERE file_handle IS NOT NULL GROUP BY 1),
m AS (SELECT cd.relative_path, cd.version_id, CASE d.operation_type WHEN 'new' THEN NULL WHEN 'rename' THEN d.comment ELSE CASE WHEN oc.n=1 AND a.n=1 THEN oc.p END END AS from_path, CASE d.operation_type WHEN 'new' THEN NULL WHEN 'rename' THEN d.version_id ELSE CASE WHEN oc.n=1 AND a.n=1 THEN oc.v END END AS from_version
 FROM cd LEFT JOIN (SELECT * FROM {log} WHERE operation_type<>'deleted') d ON d.relative_path=cd.relative_path AND d.version_id=cd.version_id LEFT JOIN oc ON oc.file_handle=cd.file_handle LEFT JOIN a ON a.file_handle=cd.file_handle),
s AS (SELECT from_path, from_version FROM m WHERE from_path IS NOT NULL UNION SELECT comment, version_id FROM {log} WHERE operation_type='rename')
SELECT relative_path, version_id, CASE WHEN from_path IS NULL THEN 'new' ELSE 'rename' END AS outcome, from_path, from_version FROM m
UNION ALL SELECT relative_path, version_id, 'deleted', NULL, NULL FROM g WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.from_path=g.relative_path AND s.from_version=g.version_id)"""


@query("base_v", "work_v", "round_log", sql=_rename("base_v", "work_v", "round_log"))
def cmp_final_rename(t: Tables):
    return compare.final_renames(t("base_v"), t("work_v"), t("round_log"))


@query("base_v", "work_v", sql="SELECT b.k, b.relative_path, b.version_id, b.file_handle FROM base_v b JOIN work_v w ON w.relative_path=b.relative_path AND w.version_id=b.version_id WHERE w.file_handle<>b.file_handle")
def cmp_displaced(t: Tables):
    return compare.displaced_rows(t("work_v"), t("base_v"))


_GONE = "g AS (SELECT * FROM base_x b WHERE NOT EXISTS (SELECT 1 FROM work_x w WHERE w.relative_path=b.relative_path)), p AS (SELECT * FROM work_x UNION ALL SELECT k, concat('twin/',relative_path), * EXCLUDE (k, relative_path) FROM work_x WHERE k%58=0)"


@query("base_x", "work_x", sql=_GONE + " SELECT relative_path, version_id, CASE WHEN n=0 THEN 'deleted' WHEN n=1 THEN 'renamed' ELSE 'ambiguous' END AS status, CASE WHEN n=1 THEN tp END AS to_path FROM (SELECT g.relative_path, g.version_id, count(p.relative_path) AS n, min(p.relative_path) AS tp FROM g LEFT JOIN p ON p.file_handle=g.file_handle AND p.entry_kind=g.entry_kind AND p.relative_path<>g.relative_path GROUP BY 1,2)")
def cmp_delete_rename_copy(t: Tables):
    gone = t("base_x").join(t("work_x").select("relative_path"), "relative_path", "left_anti")
    twins = t("work_x").where("k%58=0").withColumn("relative_path", F.concat(F.lit("twin/"), "relative_path"))
    return compare.delete_or_rename(gone, t("work_x").unionByName(twins))


@query("base_x", sql="SELECT k, relative_path FROM base_x WHERE generation<>1 AND confirmed")
def cmp_deleted(t: Tables):
    return compare.deleted(t("base_x"), 1).select("k", "relative_path")


@query("base_x", "work_x", sql="SELECT DISTINCT b.relative_path, CASE WHEN w.relative_path IS NOT NULL THEN 'retired' ELSE 'deleted' END AS verdict FROM base_x b LEFT JOIN work_x w ON w.relative_path=b.relative_path")
def cmp_recovery_delete(t: Tables):
    return compare.recovery_delete(t("base_x"), t("work_x"))


@query("base_x", "work_x", sql=f"""c AS ({_CLASSIFY.replace('w.k, w.size', 'w.k, w.relative_path, w.version_id, w.size')}), x AS (SELECT relative_path, version_id, change FROM c WHERE k%9=0 AND change IN ('data_changed','metadata_changed','directory_marker_removed')),
s AS (SELECT w.relative_path, w.size, coalesce(b.k IS NOT NULL AND w.file_handle IS NOT DISTINCT FROM b.file_handle AND b.copy_data_confirmed, FALSE) AS copy_data_confirmed, coalesce(b.k IS NOT NULL AND w.file_handle IS NOT DISTINCT FROM b.file_handle AND b.copy_path_confirmed, FALSE) AS copy_path_confirmed, w.copy_sequence, w.generation
 FROM work_x w LEFT JOIN base_x b ON b.relative_path=w.relative_path WHERE w.relative_path NOT IN (SELECT relative_path FROM x)),
r AS (SELECT b.relative_path, b.size, b.copy_data_confirmed AND x.change IN ('directory_marker_removed','metadata_changed'), b.copy_path_confirmed AND x.change='directory_marker_removed', b.copy_sequence+1, b.generation FROM base_x b JOIN x ON x.relative_path=b.relative_path)
SELECT relative_path, size, copy_data_confirmed, copy_path_confirmed, copy_sequence FROM (SELECT relative_path, size, copy_data_confirmed, copy_path_confirmed, copy_sequence, generation FROM base_x UNION ALL SELECT * FROM s UNION ALL SELECT * FROM r) QUALIFY row_number() OVER (PARTITION BY relative_path ORDER BY copy_sequence DESC, generation DESC)=1""")  # fmt: skip
def cmp_merge_base(t: Tables):
    excluded = compare.classify(t("work_x"), t("base_x")).where("k%9=0 and change in ('data_changed','metadata_changed','directory_marker_removed')")
    return compare.merge_base(t("work_x"), t("base_x"), excluded).select("relative_path", "size", "copy_data_confirmed", "copy_path_confirmed", "copy_sequence")


@query("source", "dest", sql="SELECT s.k, CASE WHEN d.k IS NULL THEN 'FullTransfer' WHEN NOT s.is_dir AND (s.mtime_ns<>d.mtime_ns OR s.size<>d.size) THEN 'DeltaTransfer' WHEN s.mode IS DISTINCT FROM d.mode OR s.uid IS DISTINCT FROM d.uid OR s.tags IS DISTINCT FROM d.tags THEN 'MetadataOnly' ELSE 'Skip' END AS decision FROM source s LEFT JOIN dest d ON d.relative_path=s.relative_path AND d.is_dir=s.is_dir")
def cmp_transfer_decision(t: Tables):
    return compare.transfer_decision(t("source"), t("dest")).select("k", "decision")


@query("source", "dest", sql="SELECT s.relative_path, CASE WHEN d.k IS NOT NULL AND s.tags IS NOT DISTINCT FROM d.tags THEN 'Skip' ELSE 'FullTransfer' END AS decision FROM source s LEFT JOIN dest d ON d.relative_path=s.relative_path AND d.is_dir WHERE s.is_dir")
def cmp_dir_marker(t: Tables):
    return compare.directory_markers(t("source"), t("dest"))


@query("source", "dest", sql="SELECT d.relative_path FROM dest d WHERE NOT EXISTS (SELECT 1 FROM source s WHERE s.relative_path=d.relative_path AND s.is_dir=d.is_dir)")
def cmp_orphans(t: Tables):
    return compare.orphans(t("dest"), t("source")).select("relative_path")


_CHECK = """j AS (SELECT s.k, d.k IS NULL AS missing, s.entry_kind<>d.entry_kind AS bad_kind, s.entry_kind=d.entry_kind AND s.entry_kind<>'directory' AND s.size<>d.size AS bad_size, NOT ({mtime}) AS bad_mtime, s.uid<>d.uid AS bad_uid, s.mode<>d.mode AS bad_mode,
 s.k%3=0 AND s.k%71=0 AS bad_owner, s.k%3=0 AND s.k%4<>0 AND s.k%53=0 AS bad_group FROM source s LEFT JOIN dest d ON d.relative_path=s.relative_path),
q AS (SELECT k, missing, concat_ws(',', CASE WHEN bad_kind THEN 'entry_kind' END, CASE WHEN bad_size THEN 'size' END) AS data, concat_ws(',', CASE WHEN bad_mtime THEN 'mtime' END, CASE WHEN bad_uid THEN 'uid' END, CASE WHEN bad_mode THEN 'mode' END, CASE WHEN bad_owner THEN 'hdfs_owner' END, CASE WHEN bad_group THEN 'hdfs_group' END) AS meta FROM j),
c AS (SELECT k, CASE WHEN missing THEN 'missing' WHEN data<>'' OR meta<>'' THEN 'mismatch' ELSE 'ok' END AS status, CASE WHEN missing THEN '' WHEN data<>'' THEN data ELSE meta END AS labels FROM q)"""
_UNIT = "CASE WHEN {x}%1000000000=0 THEN 1000000000 WHEN {x}%1000000=0 THEN 1000000 WHEN {x}%1000=0 THEN 1000 ELSE 1 END"


def _sides(t: Tables):
    """A third of the entries have named owners; some changed, and some groups are not known there."""
    named = F.col("k") % 3 == 0
    source = t("source").withColumns({"hdfs_owner": F.when(named, "hdfs"), "hdfs_group": F.when(named, "staff")})
    owner = F.when(named, F.when(F.col("k") % 71 == 0, "root").otherwise("hdfs"))
    group = F.when(named & (F.col("k") % 4 != 0), F.when(F.col("k") % 53 == 0, "wheel").otherwise("staff"))
    return source, t("dest").withColumns({"hdfs_owner": owner, "hdfs_group": group})


@query("source", "dest", sql=_CHECK.format(mtime="abs(s.mtime_ns-d.mtime_ns)<=0") + " SELECT k, status, labels FROM c")
def cmp_integrity_quick(t: Tables):
    return integrity.quick_check(*_sides(t)).select("k", "status", F.array_join("labels", ",").alias("labels"))


@query("files", sql="SELECT relative_path, CASE WHEN doc_id%9=0 THEN 'missing' WHEN doc_id%4=0 THEN 'mismatch' ELSE 'ok' END AS status FROM files")
def cmp_integrity_full(t: Tables):
    other = t("files").where("doc_id%9<>0").withColumn("content", F.when(F.col("doc_id") % 4 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return integrity.content_check(t("files"), other)


_AUTO = f"abs(s.mtime_ns//greatest({_UNIT.format(x='s.mtime_ns')},{_UNIT.format(x='d.mtime_ns')})-d.mtime_ns//greatest({_UNIT.format(x='s.mtime_ns')},{_UNIT.format(x='d.mtime_ns')}))*greatest({_UNIT.format(x='s.mtime_ns')},{_UNIT.format(x='d.mtime_ns')})<=2000000"


@query("source", "dest", sql=_CHECK.format(mtime=_AUTO) + " SELECT k, status, labels FROM c")
def cmp_mtime_precision(t: Tables):
    return integrity.quick_check(*_sides(t), mode="auto", tolerance_ms=2).select("k", "status", F.array_join("labels", ",").alias("labels"))


@query("source", "dest", sql=_CHECK.format(mtime="abs(s.mtime_ns-d.mtime_ns)<=10000000") + " SELECT k, CASE WHEN status='missing' OR regexp_matches(labels,'entry_kind|size|mtime') THEN 'content' ELSE 'metadata' END AS fix FROM c WHERE status<>'ok'")
def cmp_integrity_fix_plan(t: Tables):
    return integrity.fix_plan(integrity.quick_check(*_sides(t), tolerance_ms=10)).select("k", "fix")


_DEST2 = "d2 AS (SELECT relative_path, entry_kind, size FROM dest UNION ALL SELECT relative_path, entry_kind, size FROM dest WHERE k%101=0)"
_VERIFY = _DEST2 + """, e AS (SELECT relative_path, count(*) AS n, min(entry_kind) AS kind, min(size) AS size FROM source GROUP BY 1), a AS (SELECT relative_path, count(*) AS n, min(entry_kind) AS kind, min(size) AS size FROM d2 GROUP BY 1),
v AS (SELECT coalesce(e.relative_path,a.relative_path) AS relative_path, CASE WHEN a.n IS NULL THEN 'missing' WHEN e.n IS NULL THEN 'extra' WHEN a.n>1 THEN 'duplicate' WHEN e.kind<>a.kind THEN 'kind' WHEN e.kind='file' AND e.size<>a.size THEN 'size' ELSE 'ok' END AS issue FROM e FULL JOIN a ON e.relative_path=a.relative_path)"""


def _verified(t: Tables):
    d = t("dest").select("relative_path", "entry_kind", "size", "k")
    return integrity.verify_manifest(t("source"), d.unionByName(d.where("k%101=0")))


@query("source", "dest", sql=_VERIFY + " SELECT relative_path, issue FROM v")
def cmp_manifest_verify(t: Tables):
    return _verified(t)


@query("source", "dest", sql=_VERIFY + ", s AS (SELECT count(*) FILTER (WHERE issue='missing') AS missing, count(*) FILTER (WHERE issue='extra') AS extra, count(*) FILTER (WHERE issue='duplicate') AS duplicate, count(*) FILTER (WHERE issue='kind') AS kind, count(*) FILTER (WHERE issue='size') AS size, count(*) FILTER (WHERE issue='ok') AS ok FROM v) SELECT *, missing+extra+duplicate+kind+size=0 AS passed FROM s")
def cmp_manifest_summary(t: Tables):
    return integrity.manifest_summary(_verified(t))


@query("base", "work", sql="SELECT relative_path, size FROM base EXCEPT ALL SELECT relative_path, size FROM work")
def cmp_prefix_regression(t: Tables):
    return integrity.prefix_regressions(t("base"), t("work"), ["relative_path", "size"])


_MOVES = "mv AS (SELECT relative_path AS from_path, concat('new/',relative_path) AS to_path, FALSE AS is_dir FROM work WHERE k%3=0 UNION ALL SELECT DISTINCT regexp_replace(relative_path,'/[^/]*$',''), concat('new/',regexp_replace(relative_path,'/[^/]*$','')), TRUE FROM work WHERE k%2=0)"


@query("base", "work", sql=_MOVES + """, g AS (SELECT relative_path FROM base WHERE k%29=0)
SELECT 0 AS rank, 'rename' AS action, m.from_path AS path, m.to_path, CAST(len(string_split(m.from_path,'/')) AS BIGINT) AS order_depth, p.from_path IS NOT NULL AND string_split(m.from_path,'/')[-1]=string_split(m.to_path,'/')[-1] AS redundant
FROM mv m LEFT JOIN (SELECT * FROM mv WHERE is_dir) p ON p.from_path=regexp_replace(m.from_path,'/[^/]*$','') AND contains(m.from_path,'/') AND p.to_path=regexp_replace(m.to_path,'/[^/]*$','')
UNION ALL SELECT 1, 'delete', relative_path, NULL, CAST(-len(string_split(relative_path,'/')) AS BIGINT), FALSE FROM g""")  # fmt: skip
def cmp_target_prune_plan(t: Tables):
    from ..functions import columns as fn

    w = t("work")
    files = w.where("k%3=0").select(F.col("relative_path").alias("from_path"), F.concat(F.lit("new/"), "relative_path").alias("to_path"), F.lit(False).alias("is_dir"))
    dirs = w.where("k%2=0").select(fn.parent("relative_path").alias("p")).distinct().select(F.col("p").alias("from_path"), F.concat(F.lit("new/"), "p").alias("to_path"), F.lit(True).alias("is_dir"))
    return integrity.target_prune_plan(files.unionByName(dirs), t("base").where("k%29=0"))


@query("copied", "copied_to", "source_now", sql="""SELECT e.relative_path, CASE WHEN e.relative_path='' OR e.is_virtual THEN 'source_cleanup_policy' WHEN NOT e.confirmed OR e.confirmed_by<>'e2' THEN 'stale_evidence' WHEN e.history_records>0 AND NOT e.history_complete THEN 'incomplete_enumeration' WHEN e.history_records>1 THEN 'source_cleanup_policy' WHEN e.marker_state IS NOT NULL THEN 'source_deletion_unconfirmed'
 WHEN d.k IS NULL OR d.entry_kind<>e.entry_kind OR (e.entry_kind='file' AND d.size<>e.size) OR (e.entry_kind='symlink' AND e.symlink_target IS DISTINCT FROM d.symlink_target) THEN 'target_persistence_unconfirmed' WHEN s.k IS NULL THEN 'already_absent'
 WHEN s.size<>e.size OR s.mtime_ns<>e.mtime_ns OR s.mode IS DISTINCT FROM e.mode OR s.uid IS DISTINCT FROM e.uid THEN 'source_deletion_unconfirmed' ELSE 'eligible' END AS verdict FROM copied e LEFT JOIN copied_to d ON d.relative_path=e.relative_path LEFT JOIN source_now s ON s.relative_path=e.relative_path""")  # fmt: skip
def cmp_source_cleanup_eligible(t: Tables):
    return integrity.source_cleanup(t("copied"), t("copied_to"), t("source_now"), "e2")


@query("base_x", "work_x", sql="SELECT k, relative_path FROM base_x WHERE file_handle IN (SELECT file_handle FROM work_x WHERE k%29=0 AND file_handle IS NOT NULL)")
def cmp_key_batch_lookup(t: Tables):
    return compare.by_handles(t("base_x"), t("work_x").where("k%29=0")).select("k", "relative_path")


@query("base_x", "work_x", sql="SELECT e.relative_path, CASE WHEN e.relative_path='' OR e.k%51=0 OR e.marker_state IS NOT NULL THEN 'keep:source_deletion_unconfirmed' WHEN p.state='absent' THEN 'delete' WHEN p.state='present' THEN 'keep:source_deletion_unconfirmed' ELSE 'keep:source_query_failed' END AS verdict FROM base_x e LEFT JOIN (SELECT relative_path, CASE WHEN k%3=0 THEN 'absent' ELSE 'present' END AS state FROM work_x) p ON p.relative_path=e.relative_path")
def gen_absence_verdict(t: Tables):
    presence = t("work_x").select("relative_path", F.when(F.col("k") % 3 == 0, "absent").otherwise("present").alias("state"))
    return integrity.absence_verdict(t("base_x").withColumn("has_history", F.col("k") % 51 == 0), presence)


_COUNTED = {"new": "'new'", "changed": "'data_changed','metadata_changed','both_changed','directory_marker_removed'", "deleted": "'deleted'", "renamed": "'rename'"}
_COUNTS = ", ".join(f"count(*) FILTER (WHERE op IN ({v})) AS {k}_count, CAST(coalesce(sum(size) FILTER (WHERE op IN ({v})),0) AS BIGINT) AS {k}_bytes" for k, v in _COUNTED.items())


@query("base_x", "work_x", sql=f"""c AS ({_CLASSIFY.replace('w.k, w.size', 'w.k, w.relative_path, w.size')}),
g AS (SELECT o.* FROM base_x o LEFT JOIN work_x l ON l.relative_path=o.relative_path WHERE l.relative_path IS NULL OR l.file_handle<>o.file_handle), oc AS (SELECT file_handle, count(*) AS n, min(relative_path) AS p FROM g WHERE file_handle IS NOT NULL GROUP BY 1),
a AS (SELECT file_handle, count(*) AS n FROM work_x WHERE file_handle IS NOT NULL GROUP BY 1),
m AS (SELECT w.relative_path, oc.p FROM work_x w LEFT JOIN base_x b ON b.relative_path=w.relative_path JOIN oc ON oc.file_handle=w.file_handle AND oc.n=1 JOIN a ON a.file_handle=w.file_handle AND a.n=1 WHERE b.k IS NULL OR w.file_handle IS DISTINCT FROM b.file_handle),
e AS (SELECT CASE WHEN m.p IS NOT NULL THEN 'rename' ELSE c.change END AS op, c.size, c.is_dir, c.is_symlink, c.is_regular_file FROM c LEFT JOIN m ON m.relative_path=c.relative_path UNION ALL SELECT 'deleted', size, is_dir, is_symlink, is_regular_file FROM g WHERE relative_path NOT IN (SELECT p FROM m))
SELECT CASE WHEN is_dir THEN 'dirs' WHEN is_symlink THEN 'links' WHEN is_regular_file THEN 'files' ELSE 'other' END AS kind, {_COUNTS} FROM e GROUP BY 1""")  # fmt: skip
def agg_delta_counts(t: Tables):
    from ..operators import stats

    return stats.delta_counts(compare.delta_events(t("work_x"), t("base_x")), weight="weight")
