"""Derived catalogue tables: one SELECT each, for Spark and for DuckDB.

Two dialect holes are filled: ``US(x)`` is a timestamp in microseconds since the
epoch, and ``STRING`` is understood by both.  Tables name their sources in
braces; sources are other derived tables or the driver's Parquet tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF_NS = 996710400000000000

_KIND = """CASE WHEN k%23=0 THEN 'directory' WHEN k%31=0 THEN 'symlink' ELSE 'file' END AS entry_kind,
 k%23=0 AS is_dir, k%23<>0 AND k%31=0 AS is_symlink, k%23<>0 AND k%31<>0 AS is_regular_file"""

TABLES: dict[str, str] = {
    "catalogue_src": """SELECT o_orderkey AS k,
 concat(split_part(o_orderpriority,'-',1),'/',CAST(year(o_orderdate) AS STRING),'/',CAST(month(o_orderdate) AS STRING),'/order_',CAST(o_orderkey AS STRING),
   CASE o_orderkey%5 WHEN 0 THEN '.TXT' WHEN 1 THEN '.csv' WHEN 2 THEN '.log' WHEN 3 THEN '.Parquet' ELSE '' END) AS relative_path,
 CASE o_orderkey%5 WHEN 0 THEN 'TXT' WHEN 1 THEN 'csv' WHEN 2 THEN 'log' WHEN 3 THEN 'Parquet' END AS ext,
 CASE o_orderkey%4 WHEN 0 THEN CAST(floor(o_totalprice) AS BIGINT) WHEN 1 THEN CAST(floor(o_totalprice) AS BIGINT)*64 WHEN 2 THEN CAST(floor(o_totalprice) AS BIGINT)*2048 ELSE CAST(floor(o_totalprice) AS BIGINT)%8192 END AS size,
 US(o_orderdate)*1000 AS mtime_ns,
 CASE WHEN o_orderkey%7=0 THEN NULL ELSE 420 END AS mode,
 CAST(o_custkey AS BIGINT) AS uid,
 CASE WHEN o_orderkey%6=0 THEN NULL ELSE concat('54534934',CAST(o_orderkey AS STRING)) END AS file_handle
FROM {orders}""",
    "base": "SELECT * FROM {catalogue_src} WHERE k%50<>0",
    "work": """SELECT k, CASE WHEN k%29=0 THEN concat('moved/',relative_path) ELSE relative_path END AS relative_path, ext,
 CASE WHEN k%11=0 THEN size+1 ELSE size END AS size, mtime_ns, CASE WHEN k%13=0 THEN 493 ELSE mode END AS mode, uid, file_handle
FROM {catalogue_src} WHERE k%37<>0""",
    "base_x": f"""SELECT b.*, '' AS version_id, CAST(k%10 AS BIGINT) AS gid, {_KIND},
 CASE WHEN k%46=0 THEN concat('m',CAST(k%5 AS STRING)) END AS marker_state, CAST(k%7 AS STRING) AS identity_key, '' AS source_version_id,
 concat('d',CAST(k%6 AS STRING)) AS metadata_digest, k%97<>0 AS confirmed, k%89<>0 AS copy_path_confirmed, k%83<>0 AS copy_data_confirmed, CAST(k%3 AS BIGINT) AS generation, CAST(1 AS BIGINT) AS copy_sequence
FROM {{base}} b""",
    "work_x": f"""SELECT w.k, w.relative_path, w.ext, w.size, w.mtime_ns, w.mode, w.uid, CASE WHEN k%61=0 THEN w.file_handle || '9' ELSE w.file_handle END AS file_handle, '' AS version_id, CAST(k%10 AS BIGINT) AS gid, {_KIND},
 CASE WHEN k%46=0 AND k%92<>0 THEN concat('m',CAST(k%5 AS STRING)) END AS marker_state, CAST((CASE WHEN k%59=0 THEN k+1 ELSE k END)%7 AS STRING) AS identity_key, '' AS source_version_id,
 concat('d',CAST((CASE WHEN k%53=0 THEN k+1 ELSE k END)%6 AS STRING)) AS metadata_digest, TRUE AS confirmed, TRUE AS copy_path_confirmed, TRUE AS copy_data_confirmed, CAST(3 AS BIGINT) AS generation, CAST(2 AS BIGINT) AS copy_sequence
FROM {{work}} w""",
    "copied": """SELECT *, k%113=0 AS is_virtual, CASE WHEN k%33=0 THEN 'e1' ELSE 'e2' END AS confirmed_by, CASE WHEN k%20=0 THEN 1+k%3 ELSE 0 END AS history_records, k%40<>0 AS history_complete,
 CASE WHEN is_symlink THEN concat('to/',CAST(k%3 AS STRING)) END AS symlink_target FROM {work_x}""",
    "copied_to": """SELECT k, relative_path, CASE WHEN k%71=0 THEN 'special' ELSE entry_kind END AS entry_kind, CASE WHEN k%47=0 THEN size+1 ELSE size END AS size, CASE WHEN k%62=0 THEN concat(symlink_target,'x') ELSE symlink_target END AS symlink_target FROM {copied} WHERE k%41<>0""",
    "source_now": """SELECT k, relative_path, CASE WHEN k%43=0 THEN size+1 ELSE size END AS size, mtime_ns, CASE WHEN k%67=0 THEN 511 ELSE mode END AS mode, uid FROM {copied} WHERE k%19<>0""",
    "base_v": """SELECT k, relative_path, 'v1' AS version_id, file_handle FROM {base_x} UNION ALL SELECT k, relative_path, 'v2', file_handle || 'b' FROM {base_x} WHERE k%3=0
 UNION ALL SELECT k, relative_path, 'v3', file_handle FROM {base_x} WHERE k%15=0""",
    "work_v": """SELECT k, relative_path, 'v1' AS version_id, file_handle FROM {work_x} UNION ALL SELECT k, relative_path, 'v2', file_handle || 'b' FROM {work_x} WHERE k%3=0 AND k%4<>0
 UNION ALL SELECT k, relative_path, 'v4', file_handle FROM {work_x} WHERE k%58=0""",
    "round_log": """SELECT 'deleted' AS operation_type, concat('gone/',relative_path) AS relative_path, 'v1' AS version_id, file_handle, NULL AS comment FROM {work_x} WHERE k%50=0 AND k%3=0
 UNION ALL SELECT 'rename', relative_path, 'v1', file_handle, concat('earlier/',relative_path) FROM {work_x} WHERE k%50=0 AND k%7=0
 UNION ALL SELECT 'new', relative_path, 'v1', file_handle, NULL FROM {work_x} WHERE k%29=0 AND k%5=0 AND k%50<>0""",
    "entries": f"""SELECT w.*, '' AS version_id, {_KIND}, CASE k%3 WHEN 0 THEN 's3' WHEN 1 THEN 'hdfs' ELSE 'nas' END AS storage_type,
 CAST(k%4 AS BIGINT) AS job_id, k%71<>0 AS confirmed, k%79=0 AS is_deleted, CAST(k%2 AS BIGINT) AS generation, k%17<>0 AS size_observed
FROM {{work}} w""",
    "versions": """SELECT relative_path, version_id, 0 AS history_segment, history_index, history_records, history_index=history_records-1 AS is_latest, size FROM (
 SELECT concat('obj/',CAST(l_orderkey AS STRING)) AS relative_path, l_orderkey AS ok,
 concat('v',CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice) AS STRING)) AS version_id,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice)-1 AS history_index,
 count(*) OVER (PARTITION BY l_orderkey) AS history_records, CAST(floor(l_extendedprice*100) AS BIGINT) AS size FROM {lineitem}) h
 WHERE NOT (ok%23=0 AND history_index=1)""",
    "histories": """SELECT relative_path, version_id, CASE WHEN ok%37=0 AND i>=3 THEN seg+1 ELSE seg END AS history_segment, idx AS history_index, CASE WHEN ok%29=0 AND i=1 THEN recs+1 ELSE recs END AS history_records,
 seg=last_seg OR (ok%31=0 AND seg=0) AS history_complete, is_latest AND ok%41<>0 AS is_latest FROM (
 SELECT relative_path, version_id, ok, history_index AS i, CAST(floor(history_index/3) AS BIGINT) AS seg, CAST(history_index%3 AS BIGINT) AS idx, CAST(least(3, history_records-3*floor(history_index/3)) AS BIGINT) AS recs,
 CAST(floor((history_records-1)/3) AS BIGINT) AS last_seg, is_latest FROM (SELECT *, CAST(substr(relative_path,5) AS BIGINT) AS ok FROM {versions}) v) h""",
    "ranges": """SELECT l_suppkey AS file_id, CAST(l_linenumber*1000 + (l_orderkey%40)*250 AS BIGINT) AS start_off,
 CAST(l_linenumber*1000 + (l_orderkey%40)*250 + CAST(l_quantity AS BIGINT)*10 AS BIGINT) AS end_off FROM {lineitem}""",
    "events_log": """SELECT event_id, event_id%3 AS round, CASE event_type WHEN 'click' THEN 'new' WHEN 'view' THEN 'data_changed' WHEN 'purchase' THEN 'deleted' WHEN 'error' THEN 'error' ELSE 'rename' END AS op,
 concat('u/',CAST(user_id AS STRING),'/',CAST(event_id AS STRING)) AS path, '' AS version_id, CAST(floor(value*100) AS BIGINT) AS bytes, US(ts) AS create_at,
 event_id%11=0 AS is_dir, event_id%13=0 AND event_id%11<>0 AS is_symlink, user_id FROM {events}""",
    "events_replayed": "SELECT * FROM {events_log} UNION ALL SELECT * FROM {events_log} WHERE event_id%5=0",
    "logs": """SELECT event_id AS line, user_id%16 AS execution, US(ts) AS at_us, CASE WHEN event_type='error' THEN 'ERROR' ELSE 'INFO' END AS level,
 CASE WHEN event_type='error' THEN concat('CopyEntry failed "p/',CAST(user_id AS STRING),'/',CAST(event_id%4 AS STRING),'": io') ELSE concat('copied p/',CAST(user_id AS STRING)) END AS message,
 concat('j',CAST(user_id%5 AS STRING)) AS job_id, user_id%8 AS recv_id, concat('p/',CAST(user_id AS STRING),'/',CAST(event_id%4 AS STRING)) AS path FROM {events}""",
    "notifications": """SELECT concat('n',CAST(event_id AS STRING)) AS id, CAST(user_id AS STRING) AS round_id, CAST(event_id%2 AS STRING) AS attempt_id, event_id+1 AS sequence, CASE WHEN event_id%7=0 THEN 2 ELSE 1 END AS kind,
 props AS payload_json, CASE WHEN event_id%3=0 THEN 1 ELSE 0 END AS delivery_revision FROM {events}""",
    "progress": """SELECT user_id AS task, event_id AS sequence, US(ts)/1000000.0 AS at_s, sum(CAST(floor(value*1000) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS bytes FROM {events}""",
    "reports": """SELECT task, rn, arrival, r0*1000 AS round_at, concat('r',CAST(r0 AS STRING)) AS round_id, a0*10 AS attempt_at, concat('a',CAST(r0 AS STRING),'-',CAST(a0 AS STRING),CASE WHEN rn%17=5 THEN 'x' ELSE '' END) AS attempt_id, CAST(rn%4+1 AS BIGINT) AS sequence, rn%12=10 AS final FROM (
 SELECT task, rn, arrival, CAST(floor((CASE WHEN rn%7=6 AND rn>=12 THEN rn-12 ELSE rn END)/12) AS BIGINT) AS r0, CAST(floor((rn%12)/4) AS BIGINT) AS a0 FROM (SELECT user_id AS task, event_id AS arrival, row_number() OVER (PARTITION BY user_id ORDER BY event_id)-1 AS rn FROM {events}) e) f""",
    "feed": """SELECT conv_id AS session, CASE WHEN conv_id%7=0 AND turn>=1 THEN turn+1 ELSE turn END AS page, CAST(length(text)%50+1 AS BIGINT) AS entries, turn=max(turn) OVER (PARTITION BY conv_id) OR (conv_id%13=0 AND turn=max(turn) OVER (PARTITION BY conv_id)-1) AS terminal,
 CAST(sum(length(text)%50+1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - (length(text)%50+1) + CASE WHEN conv_id%11=0 AND turn=1 THEN 1 ELSE 0 END AS BIGINT) AS first_id,
 CASE WHEN turn=max(turn) OVER (PARTITION BY conv_id) THEN sum(CAST(length(text)%50+1 AS BIGINT)) OVER (PARTITION BY conv_id) + CASE WHEN conv_id%9=0 THEN 1 ELSE 0 END END AS declared FROM {conversations}""",
    "url_tree": """SELECT page_id AS k, concat(split_part(split_part(url,'://',2),'?',1)) AS relative_path, CAST(length(html) AS BIGINT) AS size, 'file' AS entry_kind, TRUE AS size_observed,
 CAST(1700000000000000000+page_id*1000000000 AS BIGINT) AS mtime_ns FROM {pages}""",
    "files": "SELECT doc_id, concat(lang,'/',source,'/',CAST(doc_id AS STRING),'.txt') AS relative_path, text AS content FROM {documents}",
    "dest": """SELECT k, relative_path, ext, CASE WHEN k%31=0 THEN size+1 ELSE size END AS size, CAST(floor(mtime_ns/1000000000) AS BIGINT)*1000000000 + CASE WHEN k%47=0 THEN 5000000000 ELSE 0 END AS mtime_ns, mode, CASE WHEN k%19=0 THEN uid+1 ELSE uid END AS uid, k%23=0 AS is_dir,
 CASE WHEN k%127=0 THEN 'symlink' WHEN k%23=0 THEN 'directory' ELSE 'file' END AS entry_kind, concat('t',CAST(k%4 AS STRING)) AS tags FROM {catalogue_src} WHERE k%41<>0
 UNION ALL SELECT k, concat('extra/',relative_path), ext, size, mtime_ns, mode, uid, FALSE, 'file', '' FROM {catalogue_src} WHERE k%43=0""",
    "source": """SELECT k, relative_path, ext, size, mtime_ns + CASE WHEN k%5=0 THEN 7000000 ELSE 0 END AS mtime_ns, mode, uid, k%23=0 AS is_dir, CASE WHEN k%23=0 THEN 'directory' ELSE 'file' END AS entry_kind,
 concat('t',CAST((CASE WHEN k%67=0 THEN k+1 ELSE k END)%4 AS STRING)) AS tags FROM {catalogue_src}""",
    "acl": """SELECT concat(s_name,'/',n_name) AS path, (s_suppkey+n_nationkey)%3<>0 AS inheritance, n_name AS trustee, n_name AS owner, (s_suppkey*7+n_nationkey)%2=0 AS inherited, s_suppkey FROM {supplier} JOIN {nation} ON n_regionkey=s_nationkey%5""",
    "copy_runs": """SELECT c_nationkey AS job_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS sequence, concat('e',CAST(c_custkey AS STRING)) AS execution_id, CASE c_custkey%4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'running' ELSE 'completed' END AS phase,
 c_custkey%5<>0 AS baseline_prepared, c_custkey%11<>0 AS retains_source, concat('b',CAST(c_nationkey AS STRING),CASE WHEN c_custkey%31=0 THEN 'x' ELSE '' END) AS binding, concat('c',CAST(floor(c_custkey/40) AS STRING)) AS contract,
 concat('s',CAST(c_custkey%3 AS STRING)) AS selection_key, c_custkey%3=1 AS filtered, c_custkey%13=0 AS relative_time, c_custkey%17=0 AS delete_target, c_custkey%6<>0 AS baseline_available FROM {customer}""",
    "dir_stats": """SELECT l_suppkey AS dir, l_orderkey*10+l_linenumber AS seq, CAST(l_quantity AS BIGINT) AS scanned, CAST(l_quantity AS BIGINT)%3 AS filtered, CAST(l_quantity AS BIGINT)%2 AS failed, CASE WHEN l_orderkey%19=0 THEN 1 ELSE 0 END AS vanished FROM {lineitem}""",
    "dir_counts": """SELECT dir, dir%7 AS job, seq, q AS scanned_files, q%3 AS filtered_files, q-q%3-q%2-v + CASE WHEN dir%7=4 AND q%5=0 THEN 1 ELSE 0 END AS retained_files, q%2 AS failed_files, v AS vanished_files,
 q%5+1 AS scanned_dirs, 1 AS filtered_dirs, q%5 AS retained_dirs, 0 AS failed_dirs, 0 AS vanished_dirs, q%4 AS scanned_links, 0 AS filtered_links, q%4 - CASE WHEN dir%7=4 AND q%5=0 THEN 1 ELSE 0 END AS retained_links, 0 AS failed_links, 0 AS vanished_links,
 q%2 AS pruned_directories, CASE WHEN q>45 THEN 1 ELSE 0 END AS truncated_directories, q*1000 AS regular_file_bytes, q%6 AS unknown_file_sizes, q*2 AS versions, q%8 AS delete_markers, q*3000 AS all_versions_bytes,
 CASE WHEN q%9=0 THEN 'interrupted' WHEN q%10=0 THEN 'unreadable' WHEN q%11<>0 THEN 'complete' END AS outcome, q%13=0 AS vanished_listing FROM (
 SELECT l_suppkey AS dir, l_orderkey*10+l_linenumber AS seq, CAST(max(l_quantity) AS BIGINT) AS q, CASE WHEN l_orderkey%19=0 THEN 1 ELSE 0 END AS v FROM {lineitem} GROUP BY l_suppkey, l_orderkey, l_linenumber) x""",
    "big_catalogue": """SELECT l_orderkey*16+rn AS k, concat(CAST(l_suppkey%50 AS STRING),'/',CAST(year(l_shipdate) AS STRING),'/',CAST(month(l_shipdate) AS STRING),'/f_',CAST(l_orderkey AS STRING),'_',CAST(rn AS STRING),CASE l_partkey%3 WHEN 0 THEN '.csv' WHEN 1 THEN '.LOG' ELSE '' END) AS relative_path,
 CASE l_partkey%3 WHEN 0 THEN 'csv' WHEN 1 THEN 'LOG' END AS ext, CAST(floor(l_extendedprice) AS BIGINT) AS size, US(l_shipdate)*1000 AS mtime_ns, CASE WHEN l_partkey%7=0 THEN NULL ELSE 420 END AS mode, CAST(l_suppkey AS BIGINT) AS uid,
 CASE WHEN l_partkey%6=0 THEN NULL ELSE concat('54534934',CAST(l_orderkey AS STRING),'_',CAST(rn AS STRING)) END AS file_handle
 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice) AS rn FROM {lineitem}) x""",
}

_SOURCE = re.compile(r"\{(\w+)\}")


def _stamps(sql: str, spark: bool) -> str:
    return re.sub(r"\bUS\(([^()]+)\)", r"unix_micros(CAST(\1 AS TIMESTAMP))" if spark else r"epoch_us(\1)", sql)


class Tables:
    """Spark's side: ``Tables(spark, sf_dir)("work")`` is a lazily built DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in TABLES:
                sql = _stamps(TABLES[name], True)
                sources = {s: self(s) for s in dict.fromkeys(_SOURCE.findall(sql))}
                self.made[name] = self.spark.sql(sql, **sources)
            else:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.made[name]


def duck_with(names: list[str]) -> str:
    """DuckDB's side: the WITH clause that defines the named tables and their sources."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in TABLES and name not in order:
            for s in _SOURCE.findall(TABLES[name]):
                need(s)
            order.append(name)

    for name in names:
        need(name)
    return ",\n".join(f"{n} AS ({_SOURCE.sub(lambda m: m[1], _stamps(TABLES[n], False))})" for n in order)
