"""Queries of the document archive, of members and of names. Documents stand for stored files, their sources for groups, customers for members."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import accounts, names
from ..operators import archive, members, paging, retrieval
from ..sources.layouts import From, Layout, read_layouts, write_layout
from ..sources.tables import table, work_folder
from .registry import query

GROUPS_SQL = """groups AS (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS group_id, CAST(substr(source, 4) AS BIGINT) % 3 AS project_id,
  'cat' || CAST(substr(source, 4) AS BIGINT) % 2 AS category, source AS group_name FROM documents)"""
DOCS_SQL = """docs AS (SELECT doc_id AS document_id, CAST(substr(source, 4) AS BIGINT) AS group_id, 'doc' || doc_id AS document_name, 'pdf' AS extension, CAST(doc_id % 7 AS INTEGER) AS major,
  CAST(doc_id // 7 % 10 AS INTEGER) AS minor, CAST(doc_id // 70 % 1000 AS INTEGER) AS patch, sha256(coalesce(text, '')) AS hash, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size,
  doc_id || '.pdf' AS stored_key, doc_id % 2 = 0 AS is_processed FROM documents)"""
ARCHIVE = f"{GROUPS_SQL}, {DOCS_SQL}"
_ORDINAL = "(major * 1000000 + minor * 1000 + patch)"


def groups_of(spark, folder):
    group = F.substring("source", 4, 10).cast("long")
    return table(spark, folder, "documents").select("source").distinct().select(group.alias("group_id"), (group % 3).alias("project_id"), F.concat(F.lit("cat"), group % 2).alias("category"), F.col("source").alias("group_name"))


def documents_of(spark, folder):
    n = F.col("doc_id")
    part = lambda by, size: (F.floor(n / by) % size).cast("int")
    text = F.coalesce("text", F.lit(""))
    return table(spark, folder, "documents").select(
        n.alias("document_id"),
        F.substring("source", 4, 10).cast("long").alias("group_id"),
        F.concat(F.lit("doc"), n).alias("document_name"),
        F.lit("pdf").alias("extension"),
        part(1, 7).alias("major"),
        part(7, 10).alias("minor"),
        part(70, 1000).alias("patch"),
        F.sha2(text, 256).alias("hash"),
        F.octet_length(text).cast("long").alias("size"),
        F.concat(n, F.lit(".pdf")).alias("stored_key"),
        (n % 2 == 0).alias("is_processed"),
        F.lit(None).cast("timestamp_ntz").alias("uploaded_at"),
        F.lit(None).cast("timestamp_ntz").alias("reuploaded_at"),
    )


_VERSION = "'v' || {0} // 1000000 || '.' || {0} // 1000 % 1000 || '.' || {0} % 1000"
_SUMMARY = f"SELECT g.group_id, group_name, category, {_VERSION.format(f'max({_ORDINAL})')} AS latest_version, count(*) AS document_count FROM groups g JOIN docs d ON g.group_id = d.group_id GROUP BY g.group_id, group_name, category"


@query("j01_group_summary", f"WITH {ARCHIVE} {_SUMMARY}")
def j01_group_summary(spark, folder):
    """Groups joined with their documents, newest version and count (j01, a01, a02, a03, p01, f32)."""
    return archive.group_summaries(groups_of(spark, folder), documents_of(spark, folder))


@query("o03_page", f"WITH {ARCHIVE} {_SUMMARY} ORDER BY group_name, group_id LIMIT 5 OFFSET 5")
def o03_page(spark, folder):
    """The second page by name (o02, o03)."""
    return paging.page(j01_group_summary(spark, folder), 1, 5, ["group_name"], "group_id")


@query("w01_versions", f"WITH {ARCHIVE} SELECT document_id, group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY major DESC, minor DESC, patch DESC, document_id) AS INTEGER) AS place FROM docs")
def w01_versions(spark, folder):
    return archive.versions(documents_of(spark, folder)).select("document_id", "group_id", "place")


@query("o01_latest", f"WITH {ARCHIVE} SELECT group_id, arg_min(document_id, place) AS document_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY major DESC, minor DESC, patch DESC, document_id) AS place FROM docs) GROUP BY group_id")
def o01_latest(spark, folder):
    return archive.latest(documents_of(spark, folder)).select("group_id", "document_id")


@query("p02_detail", f"WITH {ARCHIVE} SELECT d.document_id, d.document_name, g.group_name, (SELECT count(*) FROM docs s WHERE s.group_id = d.group_id) AS n_versions FROM docs d JOIN groups g ON g.group_id = d.group_id WHERE d.document_id = 11")
def p02_detail(spark, folder):
    found = archive.detail(documents_of(spark, folder), groups_of(spark, folder), 11)
    return found.select("document_id", "document_name", "group_name", "n_versions")


@query("a12_hash_copies", f"WITH {ARCHIVE} SELECT project_id, hash, count(*) AS copies FROM docs JOIN groups USING (group_id) GROUP BY project_id, hash HAVING count(*) > 1")
def a12_hash_copies(spark, folder):
    return archive.hash_copies(documents_of(spark, folder), groups_of(spark, folder))


@query("p12_has_hash", f"WITH {ARCHIVE} SELECT count(*) > 0 AS found FROM docs JOIN groups USING (group_id) WHERE project_id = 1 AND hash = (SELECT min(hash) FROM docs)")
def p12_has_hash(spark, folder):
    """Whether a project holds a content (p12, a05, j02)."""
    documents, groups = documents_of(spark, folder), groups_of(spark, folder)
    least = documents.agg(F.min("hash").alias("hash"))
    own = groups.where("project_id = 1").select("group_id")
    return documents.join(F.broadcast(least), "hash").join(own, "group_id", "left_semi").agg((F.count("*") > 0).alias("found"))


@query("a04_count", f"WITH {ARCHIVE} SELECT count(*) AS documents FROM docs WHERE group_id = 4")
def a04_count(spark, folder):
    return documents_of(spark, folder).where("group_id = 4").agg(F.count("*").alias("documents"))


@query("a13_key_violations", f"WITH {ARCHIVE} SELECT group_id, major, minor, count(*) AS rows FROM docs GROUP BY group_id, major, minor HAVING count(*) > 1")
def a13_key_violations(spark, folder):
    """As if patches did not count, so that there are some."""
    return archive.key_violations(documents_of(spark, folder), "group_id", "major", "minor")


@query("p04_existing", f"WITH {ARCHIVE} SELECT count(*) AS taken FROM (SELECT DISTINCT group_id, major + 1 AS major, minor, patch, document_id FROM docs) r WHERE EXISTS (SELECT 1 FROM docs d WHERE d.group_id = r.group_id AND d.major = r.major AND d.minor = r.minor AND d.patch = r.patch)")
def p04_existing(spark, folder):
    """Requested versions that exist already (p04, j10)."""
    documents = documents_of(spark, folder)
    requests = documents.select("group_id", (F.col("major") + 1).alias("major"), "minor", "patch")
    return archive.existing(requests, documents, "group_id", "major", "minor", "patch").agg(F.count("*").alias("taken"))


@query("j09_empty_groups", f"WITH {ARCHIVE} SELECT group_id FROM groups g WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.group_id = g.group_id AND d.group_id % 5 <> 0)")
def j09_empty_groups(spark, folder):
    documents = documents_of(spark, folder)
    return archive.empty_groups(groups_of(spark, folder), documents.where(F.col("group_id") % 5 != 0)).select("group_id")


@query("j05_one_to_one", f"WITH {ARCHIVE} SELECT document_id, hash, source FROM docs JOIN documents ON doc_id = document_id")
def j05_one_to_one(spark, folder):
    """Documents with the record of the same id (j05, j06)."""
    return documents_of(spark, folder).join(table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), "source"), "document_id").select("document_id", "hash", "source")


_REQUESTS_SQL = "requests AS (SELECT doc_id AS seq, doc_id % 4 AS project_id, 'cat' || doc_id % 2 AS category, CASE WHEN doc_id % 3 = 0 THEN source ELSE 'new' || doc_id % 50 END AS group_name, CAST(doc_id % 1200 AS INTEGER) AS major, 0 AS minor, 0 AS patch, 'a.' || doc_id || '.pdf' AS file_name, 'h' || doc_id // 2 AS hash, CASE WHEN doc_id % 17 = 0 THEN 0 ELSE 5 END AS size FROM documents)"


def _requests(spark, folder):
    n = F.col("doc_id")
    return table(spark, folder, "documents").select(
        n.alias("seq"), (n % 4).alias("project_id"), F.concat(F.lit("cat"), n % 2).alias("category"), F.when(n % 3 == 0, F.col("source")).otherwise(F.concat(F.lit("new"), n % 50)).alias("group_name"), (n % 1200).cast("int").alias("major"), F.lit(0).alias("minor"), F.lit(0).alias("patch"),
        F.concat(F.lit("a."), n, F.lit(".pdf")).alias("file_name"), F.concat(F.lit("h"), F.floor(n / 2)).alias("hash"), F.when(n % 17 == 0, 0).otherwise(5).alias("size"),
    )


@query(
    "d01_upload",
    f"""WITH RECURSIVE {ARCHIVE}, {_REQUESTS_SQL}, r AS (SELECT row_number() OVER (ORDER BY seq) AS n, seq, project_id || '/' || category || '/' || group_name AS name, project_id || '/' || hash AS content,
    CASE WHEN size <= 0 THEN 'no_file' WHEN major > 999 THEN 'bad_fields' WHEN project_id > 2 THEN 'no_project' END AS bad,
    EXISTS (SELECT 1 FROM groups g WHERE g.project_id = q.project_id AND g.category = q.category AND g.group_name = q.group_name) AS stored FROM requests q),
  loop AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS seq, []::VARCHAR[] AS names, []::VARCHAR[] AS contents, NULL::VARCHAR AS fate UNION ALL
    SELECT n, seq, CASE WHEN fate = 'added' THEN list_append(names, name) ELSE names END, CASE WHEN fate = 'added' THEN list_append(contents, content) ELSE contents END, fate
    FROM (SELECT r.*, names, contents, CASE WHEN bad IS NOT NULL THEN bad WHEN stored OR list_contains(names, name) THEN 'group_exists' WHEN list_contains(contents, content) THEN 'same_content' ELSE 'added' END AS fate FROM loop JOIN r ON r.n = loop.n + 1))
  SELECT fate, count(*) AS requests, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(seq) AS BIGINT) AS seqs FROM loop WHERE n > 0 GROUP BY fate""",
)
def d01_upload(spark, folder):
    groups = groups_of(spark, folder)
    added, refused = archive.upload_documents(_requests(spark, folder), groups, documents_of(spark, folder), groups.select("project_id").distinct())
    fates = added.select("seq", F.lit("added").alias("fate")).unionByName(refused.select("seq", F.col("reason").alias("fate")))
    return fates.groupBy("fate").agg(F.count("*").alias("requests"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum("seq").alias("seqs"))


@query(
    "d02_new_version",
    f"""WITH RECURSIVE {ARCHIVE}, q AS (SELECT doc_id AS seq, doc_id % 25 AS group_id, CAST(doc_id % 7 AS INTEGER) AS major, CAST(doc_id // 7 % 10 AS INTEGER) AS minor, CAST(doc_id % 3 AS INTEGER) AS patch, 'h' || doc_id // 2 % 100 AS hash FROM documents),
  r AS (SELECT row_number() OVER (ORDER BY seq) AS n, seq, q.group_id || '/' || major || '/' || minor || '/' || patch AS version, project_id || '/' || hash AS content, g.group_id IS NULL AS nowhere,
    EXISTS (SELECT 1 FROM docs d WHERE d.group_id = q.group_id AND d.major = q.major AND d.minor = q.minor AND d.patch = q.patch) AS stored FROM q LEFT JOIN groups g ON g.group_id = q.group_id),
  loop AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS seq, []::VARCHAR[] AS versions, []::VARCHAR[] AS contents, NULL::VARCHAR AS fate UNION ALL
    SELECT n, seq, CASE WHEN fate = 'added' THEN list_append(versions, version) ELSE versions END, CASE WHEN fate = 'added' THEN list_append(contents, content) ELSE contents END, fate
    FROM (SELECT r.*, versions, contents, CASE WHEN nowhere THEN 'no_group' WHEN stored OR list_contains(versions, version) THEN 'version_exists' WHEN list_contains(contents, content) THEN 'same_content' ELSE 'added' END AS fate FROM loop JOIN r ON r.n = loop.n + 1))
  SELECT seq, fate FROM loop WHERE n > 0""",
)
def d02_new_version(spark, folder):
    n = F.col("doc_id")
    requests = table(spark, folder, "documents").select(n.alias("seq"), (n % 25).alias("group_id"), (n % 7).cast("int").alias("major"), (F.floor(n / 7) % 10).cast("int").alias("minor"), (n % 3).cast("int").alias("patch"), F.lit("x.pdf").alias("file_name"), F.concat(F.lit("h"), F.floor(n / 2) % 100).alias("hash"), F.lit(1).alias("size"))
    added, refused = archive.upload_versions(requests, groups_of(spark, folder), documents_of(spark, folder))
    return added.select("seq", F.lit("added").alias("fate")).unionByName(refused.select("seq", F.col("reason").alias("fate")))


_CHANGES_SQL = """changes AS (
    SELECT document_id AS seq, document_id, CASE WHEN document_id % 5 = 0 THEN 900 + document_id % 90 ELSE major END AS new_major, minor AS new_minor, patch AS new_patch, CASE WHEN document_id % 4 = 0 THEN 'new' || document_id // 8 WHEN document_id % 4 = 1 THEN hash END AS new_hash, is_processed <> (document_id % 10 = 3) AS new_processed FROM docs WHERE document_id % 2 = 0 OR document_id % 3 = 0
    UNION ALL SELECT 10000000 + document_id, document_id + CASE WHEN document_id % 3 = 0 THEN 25 ELSE 0 END, major, minor, patch, CASE WHEN document_id % 2 = 0 THEN hash END, true FROM docs WHERE document_id % 5 = 0)"""


@query(
    "d03_update",
    f"""WITH RECURSIVE {ARCHIVE}, {_CHANGES_SQL}, o AS (SELECT d.document_id AS doc, d.group_id AS grp, project_id AS proj, major || '.' || minor || '.' || patch AS ver, hash, is_processed FROM docs d JOIN groups USING (group_id)),
  b AS (SELECT c.*, o.*, new_major || '.' || new_minor || '.' || new_patch AS new_ver FROM changes c LEFT JOIN o ON o.doc = c.document_id),
  r AS (SELECT row_number() OVER (ORDER BY seq) AS n, *, (SELECT list(h.doc) FROM o h WHERE h.grp = b.grp AND h.ver = b.new_ver) AS vh, (SELECT list(h.doc) FROM o h WHERE h.proj = b.proj AND h.hash = b.new_hash) AS ch FROM b),
  loop AS (SELECT 0::BIGINT AS n, []::STRUCT(doc BIGINT, grp BIGINT, proj BIGINT, ver VARCHAR, hash VARCHAR, processed BOOLEAN, major INTEGER)[] AS now UNION ALL
    SELECT n, CASE WHEN doc IS NULL OR NOT (v OR f OR p) OR (v AND vheld) OR (f AND cheld) THEN now
      ELSE list_append(list_filter(now, lambda x: x.doc <> doc), {{'doc': doc, 'grp': grp, 'proj': proj, 'ver': new_ver, 'hash': CASE WHEN f THEN new_hash ELSE cur.hash END, 'processed': new_processed, 'major': CAST(new_major AS INTEGER)}}) END
    FROM (SELECT *, new_ver <> cur.ver AS v, new_hash IS NOT NULL AND new_hash <> cur.hash AS f, new_processed <> cur.processed AS p,
        len(list_filter(now, lambda x: x.grp = grp AND x.ver = new_ver)) > 0 OR len(list_filter(coalesce(vh, []), lambda d: NOT list_contains(moved, d))) > 0 AS vheld,
        len(list_filter(now, lambda x: x.proj = proj AND x.hash = new_hash)) > 0 OR len(list_filter(coalesce(ch, []), lambda d: NOT list_contains(moved, d))) > 0 AS cheld
      FROM (SELECT r.*, now, list_transform(now, lambda x: x.doc) AS moved, coalesce(list_filter(now, lambda x: x.doc = r.doc)[1], {{'doc': doc, 'grp': grp, 'proj': proj, 'ver': ver, 'hash': hash, 'processed': is_processed, 'major': CAST(0 AS INTEGER)}}) AS cur FROM loop JOIN r ON r.n = loop.n + 1))),
  k AS (SELECT unnest(now) AS x FROM loop WHERE n = (SELECT max(n) FROM loop))
  SELECT d.document_id, coalesce(x.major, d.major) AS major, coalesce(x.hash, d.hash) AS hash, coalesce(x.processed, d.is_processed) AS is_processed, x IS NOT NULL AS changed FROM docs d LEFT JOIN k ON x.doc = d.document_id""",
)
def d03_update(spark, folder):
    """Changed versions, contents and flags; some of what is freed is asked for again, by the same or another document (d03, p15)."""
    documents, groups = documents_of(spark, folder), groups_of(spark, folder)
    n, fixed = F.col("document_id"), [F.lit(9).cast("long").alias("new_size"), F.lit("n.v2.png").alias("new_file_name")]
    first = documents.where((n % 2 == 0) | (n % 3 == 0)).select(
        n.alias("seq"), "document_id", F.when(n % 5 == 0, 900 + n % 90).otherwise(F.col("major")).cast("int").alias("new_major"), F.col("minor").alias("new_minor"), F.col("patch").alias("new_patch"),
        F.when(n % 4 == 0, F.concat(F.lit("new"), F.floor(n / 8))).when(n % 4 == 1, F.col("hash")).alias("new_hash"), *fixed, (F.col("is_processed") != (n % 10 == 3)).alias("new_is_processed"),
    )
    then = documents.where(n % 5 == 0).select((n + 10_000_000).alias("seq"), (n + F.when(n % 3 == 0, 25).otherwise(0)).alias("document_id"), *(F.col(c).alias(f"new_{c}") for c in archive.VERSION), F.when(n % 2 == 0, F.col("hash")).alias("new_hash"), *fixed, F.lit(True).alias("new_is_processed"))
    after, _ = archive.update_documents(documents, groups, first.unionByName(then), F.lit("2024-03-01").cast("timestamp_ntz"))
    return after.select("document_id", "major", "hash", "is_processed", F.col("reuploaded_at").isNotNull().alias("changed"))


@query("d04_delete", f"WITH {ARCHIVE}, kept AS (SELECT * FROM docs WHERE document_id % 3 <> 0 AND group_id <> 2) SELECT g.group_id, count(k.document_id) AS documents FROM groups g LEFT JOIN kept k ON k.group_id = g.group_id WHERE g.group_id <> 2 GROUP BY g.group_id")
def d04_delete(spark, folder):
    documents, groups = documents_of(spark, folder), groups_of(spark, folder)
    gone = documents.where((F.col("document_id") % 3 == 0) | (F.col("group_id") == 2)).select("document_id")
    kept, left = archive.delete_documents(documents, groups, gone)
    return left.join(kept.select("group_id", "document_id"), "group_id", "left").groupBy("group_id").agg(F.count("document_id").alias("documents"))


@query("d05_rename", f"WITH {ARCHIVE} SELECT group_id, CASE WHEN group_id % 2 = 0 THEN 'renamed' || group_id ELSE group_name END AS group_name FROM groups")
def d05_rename(spark, folder):
    """New names; a request for the name that a group has is refused."""
    groups = groups_of(spark, folder)
    changes = groups.select("group_id", F.when(F.col("group_id") % 2 == 0, F.concat(F.lit("renamed"), F.col("group_id"))).otherwise(F.col("group_name")).alias("new_value"))
    rows, _ = archive.relabel_groups(groups, changes, "group_name")
    return rows.select("group_id", "group_name")


@query("d06_category", f"WITH {ARCHIVE} SELECT group_id, CASE WHEN group_id % 2 = 0 THEN 'moved' ELSE category END AS category FROM groups")
def d06_category(spark, folder):
    groups = groups_of(spark, folder)
    changes = groups.select("group_id", F.when(F.col("group_id") % 2 == 0, "moved").otherwise(F.col("category")).alias("new_value"))
    rows, _ = archive.relabel_groups(groups, changes, "category")
    return rows.select("group_id", "category")


#: Months before February are in the first layout: numbers for ids, another name of the text, no time of creation.
_TODAY = "log_id string, occurred_at timestamp_ntz, archive string, session_id string, created_at timestamp_ntz"
_LAYOUTS = [
    Layout(1, "log_id long, occurred_at timestamp_ntz, body string", {"log_id": From("log_id", stored=lambda text: int(text) if text.isdecimal() and str(int(text)) == text else None), "archive": From("body"), "session_id": From(default="unknown-session"), "created_at": From(default=dt.datetime(2024, 2, 1))}),
    Layout(2, _TODAY),
]


def _layouts(spark, folder, **more):
    root = work_folder(spark, "layouts")
    days = F.make_dt_interval(days=(F.col("event_id") % 60).cast("int"))
    events = table(spark, folder, "events").select("event_id", "event_type", "user_id", (F.col("ts") + days).alias("occurred_at"))
    old, new = events.where("occurred_at < TIMESTAMP_NTZ '2024-02-01'"), events.where("occurred_at >= TIMESTAMP_NTZ '2024-02-01'")
    write_layout(old.select(F.col("event_id").alias("log_id"), "occurred_at", F.col("event_type").alias("body")), root, _LAYOUTS[0])
    write_layout(new.select(F.col("event_id").cast("string").alias("log_id"), "occurred_at", F.col("event_type").alias("archive"), F.concat(F.lit("s"), "user_id").alias("session_id"), F.col("occurred_at").alias("created_at")), root, _LAYOUTS[1])
    return read_layouts(spark, root, _LAYOUTS, _TODAY, **more)


_LAYOUT_ROWS = """e AS (SELECT event_id, event_type, user_id, ts + INTERVAL 1 DAY * (event_id % 60) AS happened FROM events),
  t AS (SELECT CAST(event_id AS VARCHAR) AS log_id, happened AS occurred_at, event_type AS archive, CASE WHEN happened < TIMESTAMP '2024-02-01' THEN 'unknown-session' ELSE 's' || user_id END AS session_id, CASE WHEN happened < TIMESTAMP '2024-02-01' THEN TIMESTAMP '2024-02-01' ELSE happened END AS created_at FROM e)"""


@query("d13_evolve", f"WITH {_LAYOUT_ROWS} SELECT * FROM t")
def d13_evolve(spark, folder):
    """Logs that were stored in an old and a new layout, as one table."""
    return _layouts(spark, folder)


@query("d13_evolved_lookup", f"WITH {_LAYOUT_ROWS} SELECT log_id, archive, session_id FROM t WHERE log_id IN ('7', '77', '0077', '777', 'x') AND archive >= 'c' AND occurred_at >= TIMESTAMP '2024-01-03'")
def d13_evolved_lookup(spark, folder):
    """Filters that reach the scans of both layouts, in their own names and types."""
    return _layouts(spark, folder, where=[("log_id", "in", ["7", "77", "0077", "777", "x"]), ("archive", ">=", "c"), ("occurred_at", ">=", dt.datetime(2024, 1, 3))], columns=["log_id", "archive", "session_id"])


MEMBERS_SQL = """members AS (SELECT CAST(c_custkey AS VARCHAR) AS member_id, CAST(CASE WHEN c_custkey % 9 <> 0 THEN c_nationkey END AS BIGINT) AS company_id, CASE WHEN c_custkey % 2 = 0 THEN 'GOOGLE' ELSE 'GITHUB' END AS provider, CAST(c_custkey // 2 AS VARCHAR) AS provider_id,
  CASE WHEN c_custkey % 10 = 0 THEN 'x@oauth.placeholder' ELSE 'u' || c_custkey // 4 || '@mail.com' END AS email, c_name AS name, c_name AS nickname, CASE WHEN c_custkey % 7 = 0 THEN 'DELETED' WHEN c_custkey % 7 = 1 THEN 'SUSPENDED' ELSE 'ACTIVE' END AS status,
  CASE c_custkey % 3 WHEN 0 THEN 'ADMIN' WHEN 1 THEN 'CEO' ELSE 'EMPLOYEE' END AS role FROM customer)"""


def members_of(spark, folder):
    n = F.col("c_custkey")
    third = n % 3
    return table(spark, folder, "customer").select(
        n.cast("string").alias("member_id"),
        F.when(n % 9 != 0, F.col("c_nationkey")).cast("long").alias("company_id"),
        F.when(n % 2 == 0, "GOOGLE").otherwise("GITHUB").alias("provider"),
        F.floor(n / 2).cast("string").alias("provider_id"),
        F.when(n % 10 == 0, "x@oauth.placeholder").otherwise(F.concat(F.lit("u"), F.floor(n / 4), F.lit("@mail.com"))).alias("email"),
        F.col("c_name").alias("name"),
        F.col("c_name").alias("nickname"),
        F.lit(None).cast("string").alias("profile_key"),
        F.lit("JUNIOR").alias("position"),
        F.when(third == 0, "ADMIN").when(third == 1, "CEO").otherwise("EMPLOYEE").alias("role"),
        F.when(n % 7 == 0, "DELETED").when(n % 7 == 1, "SUSPENDED").otherwise("ACTIVE").alias("status"),
        F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
    )


@query("j03_company", f"WITH {MEMBERS_SQL} SELECT member_id, company_id, n_name AS company FROM members LEFT JOIN nation ON n_nationkey = company_id")
def j03_company(spark, folder):
    companies = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("company_id"), F.col("n_name").alias("company"))
    return members.with_company(members_of(spark, folder), companies).select("member_id", "company_id", "company")


@query("p05_other_provider", f"WITH {MEMBERS_SQL} SELECT member_id FROM members WHERE email = 'u7@mail.com' AND provider <> 'GOOGLE' AND status <> 'DELETED'")
def p05_other_provider(spark, folder):
    return members.same_email_elsewhere(members_of(spark, folder), "u7@mail.com", "GOOGLE").select("member_id")


@query("d08_conflicts", f"WITH {MEMBERS_SQL} SELECT a.email, a.provider, min(b.provider) AS conflicting FROM (SELECT DISTINCT email, provider FROM members WHERE email NOT LIKE '%@oauth.placeholder') a JOIN members b ON a.email = b.email AND a.provider <> b.provider AND b.status <> 'DELETED' GROUP BY a.email, a.provider")
def d08_conflicts(spark, folder):
    rows = members_of(spark, folder)
    return members.email_conflicts(rows.select("email", "provider").distinct(), rows)


@query(
    "d07_sign_in",
    f"""WITH {MEMBERS_SQL}, r AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 2 = 0 THEN 'GOOGLE' ELSE 'GITHUB' END AS provider, CAST(c_custkey // 4 + (SELECT max(c_custkey) FROM customer) * 3 // 8 AS VARCHAR) AS provider_id, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 1 THEN 'nick' END AS nickname, CASE WHEN c_custkey % 2 = 0 THEN 'ceo' ELSE 'admin' END AS role FROM customer),
  f AS (SELECT *, row_number() OVER (PARTITION BY provider, provider_id ORDER BY seq) AS k FROM r)
  SELECT provider, provider_id, CASE WHEN trim(name) = '' THEN '사용자' ELSE name END AS name, coalesce(nickname, CASE WHEN trim(name) = '' THEN '사용자' ELSE name END) AS nickname, CASE WHEN role = 'ceo' THEN 'CEO' ELSE 'EMPLOYEE' END AS role, 'JUNIOR' AS position, 'ACTIVE' AS status
  FROM f WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM members m WHERE m.provider = f.provider AND m.provider_id = f.provider_id)""",
)
def d07_sign_in(spark, folder):
    """New members from sign-ins (d07, f39, f40)."""
    customers = table(spark, folder, "customer")
    most = customers.agg(F.floor(F.max("c_custkey") * 3 / 8).alias("_most"))
    n = F.col("c_custkey")
    requests = customers.join(F.broadcast(most)).select(
        n.alias("seq"), F.when(n % 2 == 0, "GOOGLE").otherwise("GITHUB").alias("provider"), (F.floor(n / 4) + F.col("_most")).cast("string").alias("provider_id"), F.lit(None).cast("string").alias("email"),
        F.when(n % 3 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.when(n % 3 == 1, "nick").alias("nickname"), F.when(n % 2 == 0, "ceo").otherwise("admin").alias("role"),
    )
    return members.sign_in(requests, members_of(spark, folder)).drop("email")


@query("d09_change", f"WITH {MEMBERS_SQL} SELECT member_id, CASE CAST(member_id AS BIGINT) % 4 WHEN 0 THEN 'SUSPENDED' WHEN 1 THEN 'DELETED' ELSE status END AS status, CASE WHEN CAST(member_id AS BIGINT) % 8 = 3 THEN 'neo' ELSE nickname END AS nickname FROM members")
def d09_change(spark, folder):
    rows = members_of(spark, folder)
    n = F.col("member_id").cast("long")
    changes = rows.where(n % 4 != 2).select(
        "member_id", F.when(n % 4 == 0, "suspend").when(n % 4 == 1, "delete").otherwise("profile").alias("action"), F.when(n % 8 == 3, "neo").otherwise(" ").alias("new_nickname"), F.lit(None).cast("string").alias("new_profile_key"), F.lit(None).cast("string").alias("new_position")
    )
    return members.change_members(rows, changes, F.lit("2024-03-01").cast("timestamp_ntz")).select("member_id", "status", "nickname")


@query("p16_states", f"WITH {MEMBERS_SQL} SELECT member_id, status = 'ACTIVE' AS active, role = 'ADMIN' AS admin, ends_with(email, '@oauth.placeholder') AS placeholder FROM members")
def p16_states(spark, folder):
    return members_of(spark, folder).select("member_id", (F.col("status") == "ACTIVE").alias("active"), (F.col("role") == "ADMIN").alias("admin"), accounts.is_placeholder(F.col("email")).alias("placeholder"))


@query("f41_placeholder", f"WITH {MEMBERS_SQL} SELECT member_id, CASE WHEN CAST(member_id AS BIGINT) % 2 = 0 THEN lower(provider) || '_' || provider_id || '@oauth.placeholder' ELSE email END AS address FROM members")
def f41_placeholder(spark, folder):
    email = F.when(F.col("member_id").cast("long") % 2 != 0, F.col("email"))
    return members_of(spark, folder).select("member_id", accounts.email_or_placeholder(email, F.col("provider"), F.col("provider_id")).alias("address"))


@query("f42_primary_email", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'b@x' WHEN 1 THEN 'a@x' END AS email FROM events""")
def f42_primary_email(spark, folder):
    """Out of a JSON list of addresses (f42, s15, o05)."""
    both = '[{"email":"a@x","primary":false,"verified":true},{"email":"b@x","primary":true,"verified":true}]'
    second = '[{"email":"a@x","primary":false,"verified":true},{"email":"b@x","primary":true,"verified":false}]'
    none = '[{"email":"a@x","primary":true,"verified":false}]'
    case = F.col("event_id") % 3
    return table(spark, folder, "events").select("event_id", accounts.primary_email_of_json(F.when(case == 0, both).when(case == 1, second).otherwise(none)).alias("email"))


@query("f55_profile", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'g' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'login' || c_custkey END AS name FROM customer""")
def f55_profile(spark, folder):
    google = F.to_json(F.struct(F.concat(F.lit("g"), F.col("c_custkey")).alias("sub"), F.col("c_name").alias("name")))
    github = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.lit(" ").alias("name"), F.concat(F.lit("login"), F.col("c_custkey")).alias("login")))
    even = F.col("c_custkey") % 2 == 0
    rows = table(spark, folder, "customer").select("c_custkey", F.when(even, "google").otherwise("github").alias("provider"), F.when(even, google).otherwise(github).alias("attributes"))
    return rows.select("c_custkey", accounts.profile(F.col("provider"), F.col("attributes")).alias("p")).select("c_custkey", "p.id", "p.name")


@query("j07_resolve", "SELECT event_id, CASE WHEN user_id % 4 < 3 THEN user_id % 4 END AS project_id FROM events")
def j07_resolve(spark, folder):
    projects = spark.range(3).select(F.concat(F.lit("p"), F.col("id")).alias("public_id"), F.col("id").alias("project_id"))
    requests = table(spark, folder, "events").select("event_id", F.concat(F.lit("p"), F.col("user_id") % 4).alias("public_id"))
    return members.resolve_projects(requests, projects).select("event_id", "project_id")


@query("f31_versions", f"WITH {ARCHIVE} SELECT document_id, CAST({_ORDINAL} AS INTEGER) AS ordinal, {_VERSION.format(_ORDINAL)} AS version, major + minor + patch AS parts FROM docs")
def f31_versions(spark, folder):
    """Packed, unpacked and parsed (f31 to f34)."""
    ordinal = names.pack_version(F.col("major"), F.col("minor"), F.col("patch"))
    rows = documents_of(spark, folder).select("document_id", ordinal.alias("ordinal"))
    version = names.unpack_version(F.col("ordinal"))
    return rows.select("document_id", "ordinal", version.alias("version"), F.aggregate(names.parse_version(version), F.lit(0), lambda a, x: a + x).alias("parts"))


@query("f35_files", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a.b' WHEN 1 THEN 'scan' WHEN 2 THEN 'x' ELSE 'dir.v1/name' END AS stem, CASE page_id % 4 WHEN 0 THEN 'PDF' WHEN 2 THEN 'jpg' END AS extension, CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 2 THEN 'image/jpeg' ELSE 'application/octet-stream' END AS type FROM pages")
def f35_files(spark, folder):
    """Stem, extension and content type (f35, f36)."""
    case = F.col("page_id") % 4
    name = F.when(case == 0, "a.b.PDF").when(case == 1, "scan").when(case == 2, "x.jpg").otherwise("dir.v1/name")
    return table(spark, folder, "pages").select("page_id", names.file_stem(name).alias("stem"), names.file_extension(name).alias("extension"), names.content_type(names.file_extension(name)).alias("type"))


@query("f37_names", f"WITH {ARCHIVE} SELECT document_id, document_name || '.' || extension AS download, document_id || '.' || extension AS stored FROM docs")
def f37_names(spark, folder):
    """Download name and stored key (f37, f38)."""
    return documents_of(spark, folder).select("document_id", names.download_name(F.col("document_name"), F.col("extension")).alias("download"), names.stored_key(F.col("extension"), F.col("document_id").cast("string")).alias("stored"))


@query("p14_whitelist", "SELECT page_id, page_id % 3 = 0 AS allowed FROM pages")
def p14_whitelist(spark, folder):
    case = F.col("page_id") % 3
    mime, extension = F.when(case == 0, "Image/PNG").when(case == 1, "text/plain").otherwise("application/pdf"), F.when(case == 2, "exe").otherwise("PNG")
    return table(spark, folder, "pages").select("page_id", names.may_upload(mime, extension).alias("allowed"))


@query("p11_ranges", f"WITH {ARCHIVE} SELECT document_id FROM docs WHERE major BETWEEN 2 AND 4 AND length(document_name) <= 5")
def p11_ranges(spark, folder):
    return documents_of(spark, folder).where(F.col("major").between(2, 4) & (F.length("document_name") <= 5)).select("document_id")


@query("p17_prefix", "SELECT page_id FROM pages WHERE starts_with(url, 'https://')")
def p17_prefix(spark, folder):
    return table(spark, folder, "pages").where(F.col("url").startswith("https://")).select("page_id")


@query("p18_not_null", "SELECT doc_id FROM documents WHERE text IS NOT NULL")
def p18_not_null(spark, folder):
    return table(spark, folder, "documents").where(F.col("text").isNotNull()).select("doc_id")


@query("s12_content_hash", f"WITH {ARCHIVE} SELECT document_id, hash, size FROM docs")
def s12_content_hash(spark, folder):
    """Content hashes and sizes (s12, f02)."""
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), F.sha2(content, 256).alias("hash"), F.octet_length(content).cast("long").alias("size"))


@query("f45_small", """SELECT event_id, CAST(event_id % 256 AS VARCHAR) || '.0.0.1' AS client, 'c' || event_id AS segment, strftime(ts, '%Y-%m-%d %H:%M') AS shown, printf('%.2f%%', event_id % 100 / 3.0) AS share, CAST(event_id // 1000 + CASE WHEN event_id % 1000 > 0 THEN 1 ELSE 0 END AS BIGINT) AS wait,
  CASE event_id % 4 WHEN 0 THEN 'UP' WHEN 1 THEN 'RECOVERING' WHEN 2 THEN 'DOWN' ELSE 'UNKNOWN' END AS health, 'refresh:' || event_id AS key, CASE WHEN event_id % 3000 > 0 THEN greatest(1, event_id % 3000 // 1000) END AS ttl FROM events""")
def f45_small(spark, folder):
    """Small formats (f45 to f47, f44, f51 to f54)."""
    n, case = F.col("event_id"), F.col("event_id") % 4
    state = F.when(case == 0, "CLOSED").when(case == 1, "HALF_OPEN").when(case == 2, "OPEN").otherwise("FORCED")
    return table(spark, folder, "events").select(
        "event_id",
        names.first_of_list(F.concat(F.lit(" "), n % 256, F.lit(".0.0.1 , 10.0.0.1"))).alias("client"),
        names.last_segment(F.concat(F.lit("a.b.c"), n)).alias("segment"),
        names.date_display(F.col("ts")).alias("shown"),
        names.percent((n % 100) / F.lit(3.0)).alias("share"),
        names.retry_after_seconds(n * 1_000_000).alias("wait"),
        names.health_of(state).alias("health"),
        names.kv_key("refresh", n.cast("string")).alias("key"),
        names.token_ttl_seconds(n % 3000).alias("ttl"),
    )


@query("o11_range_text", f"WITH {ARCHIVE} SELECT group_id, '11-' || least(20, count(*)) || ' / ' || count(*) AS shown FROM docs GROUP BY group_id")
def o11_range_text(spark, folder):
    counted = documents_of(spark, folder).groupBy("group_id").agg(F.count("*").alias("n"))
    return counted.select("group_id", paging.range_text(11, 10, F.col("n")).alias("shown"))


@query("x01_cosine", """WITH q AS (SELECT vec_id, embedding FROM embeddings ORDER BY vec_id LIMIT 1) SELECT e.vec_id, round(list_cosine_similarity(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(q.embedding, lambda x: CAST(x AS DOUBLE))), 6) AS score FROM embeddings e, q WHERE e.vec_id <> q.vec_id ORDER BY score DESC, e.vec_id LIMIT 10""")
def x01_cosine(spark, folder):
    """The ten vectors nearest to the first one, for the declared vector store."""
    vectors = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    asked = vectors.orderBy("vec_id").limit(1).select(F.col("vec_id").alias("q_id"), F.col("v").alias("q"))  # one row
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = vectors.join(F.broadcast(asked)).where("vec_id != q_id").select("vec_id", F.round(dot(F.col("v"), F.col("q")) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("q"), F.col("q"))), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(10)


@query(
    "x03_passages",
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
  p AS (SELECT doc_id, passage, w[passage * 100 + 1 : passage * 100 + 100] AS terms FROM (SELECT doc_id, w, unnest(range((len(w) + 99) // 100)) AS passage FROM d)),
  a AS (SELECT count(*) AS docs, sum(len(terms)) AS terms FROM p),
  t AS (SELECT doc_id, passage, n, term, count(*) AS tf FROM (SELECT doc_id, passage, len(terms) AS n, unnest(terms) AS term FROM p) GROUP BY ALL),
  i AS (SELECT t.*, floor(1000 * ln(1 + (docs - df + 0.5) / (df + 0.5)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * n / (a.terms / a.docs))))::BIGINT AS impact FROM t JOIN (SELECT term, count(*) AS df FROM t GROUP BY term) USING (term), a),
  q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
  s AS (SELECT item_id, doc_id, passage, sum(impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY ALL)
  SELECT item_id, rank, doc_id, passage::INTEGER AS passage, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, passage)::INTEGER AS rank FROM s WHERE score > 0) WHERE rank <= 5""",
)
def x03_passages(spark, folder):
    """The five passages that answer each question best, for the declared document search."""
    found = retrieval.passages(table(spark, folder, "documents"), "doc_id", "text")
    return retrieval.retrieve(found, table(spark, folder, "benchmark"), 5, "doc_id", "item_id", "text")
