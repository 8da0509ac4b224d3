"""The versioned document archive: summaries, versions, and changes as transforms of its two tables.

Groups are (group_id, project_id, category, group_name); documents are one version each (see sources.schemas). A change takes a table of requests, each with
a ``seq`` that orders them, and gives the rows to add or the new table, and what was refused, with a reason. Requests of one table see the stored state and, where they compete for one key, the
accepted earlier ones, as if they came one by one (see ``acceptance``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import file_extension, file_stem, pack_version, unpack_version, version_text
from ..functions.text import choseong
from .acceptance import Slot, accept_in_order, key_of

VERSION = ["major", "minor", "patch"]


def group_summaries(groups: DataFrame, documents: DataFrame) -> DataFrame:
    """group_id, group_name, category, latest_version, document_count: groups without documents are left out."""
    ordinal = pack_version(*(F.col(c) for c in VERSION))
    counted = documents.groupBy("group_id").agg(F.max(ordinal).alias("latest"), F.count("*").alias("document_count"))
    return groups.join(counted, "group_id").select("group_id", "group_name", "category", unpack_version(F.col("latest")).alias("latest_version"), "document_count")


def versions(documents: DataFrame) -> DataFrame:
    """Documents with ``place`` in their group, newest version first.

    Ranked within (group, major, minor), behind the counts of the newer ones, so that a group of any size is dealt over many tasks.
    """
    by_minor = documents.groupBy("group_id", "major", "minor").agg(F.count("*").alias("_n"))
    newer = Window.partitionBy("group_id").orderBy(F.desc("major"), F.desc("minor")).rowsBetween(Window.unboundedPreceding, -1)
    before = by_minor.select("group_id", "major", "minor", F.coalesce(F.sum("_n").over(newer), F.lit(0)).alias("_before"))
    own = Window.partitionBy("group_id", "major", "minor").orderBy(F.desc("patch"), "document_id")
    placed = documents.withColumn("_own", F.row_number().over(own)).join(before, ["group_id", "major", "minor"])
    return placed.withColumn("place", (F.col("_before") + F.col("_own")).cast("int")).select(*documents.columns, "place")


def latest(documents: DataFrame) -> DataFrame:
    """The newest version of each group, summed up before the shuffle."""
    row = F.struct(*VERSION, (-F.col("document_id")).alias("_tie"), *(c for c in documents.columns if c not in VERSION))
    best = documents.groupBy("group_id").agg(F.max(F.struct(F.struct(*VERSION, (-F.col("document_id"))).alias("k"), row.alias("row"))).alias("best"))
    return best.select(*(F.col(f"best.row.{c}").alias(c) for c in documents.columns))


def siblings(documents: DataFrame, document_id: int) -> DataFrame:
    """All versions of a document, itself included, newest first, one row each."""
    asked = documents.where(F.col("document_id") == document_id).select("group_id")  # one row
    return documents.join(F.broadcast(asked), "group_id", "left_semi").orderBy(*(F.desc(c) for c in VERSION), "document_id")


def detail(documents: DataFrame, groups: DataFrame, document_id: int) -> DataFrame:
    """One document with its group and n_versions, the count of its versions; ``siblings`` lists them."""
    asked = documents.where(F.col("document_id") == document_id)
    of_group = documents.join(F.broadcast(asked.select("group_id")), "group_id", "left_semi")  # one row
    return asked.join(groups, "group_id").join(of_group.groupBy("group_id").agg(F.count("*").alias("n_versions")), "group_id")


def hash_copies(documents: DataFrame, groups: DataFrame) -> DataFrame:
    """project_id, hash, copies: contents that a project holds more than once."""
    owned = documents.join(groups.select("group_id", "project_id"), "group_id")
    return owned.groupBy("project_id", "hash").agg(F.count("*").alias("copies")).where("copies > 1")


def has_hash(documents: DataFrame, groups: DataFrame, project_id, hash_value: str) -> DataFrame:
    """One row: found, whether the project holds the content."""
    own = groups.where(F.col("project_id") == project_id).select("group_id")
    return documents.where(F.col("hash") == hash_value).join(own, "group_id", "left_semi").agg((F.count("*") > 0).alias("found"))


def key_violations(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def by_initials(documents: DataFrame, wanted: DataFrame, longest: int = 8) -> DataFrame:
    """wanted (key) with the documents (document_id, document_name) whose names' initial consonants begin with it: an equality join on the beginnings of ``longest`` characters at most. Longer keys find nothing."""
    initials = documents.select("document_id", "document_name", choseong(F.col("document_name")).alias("_key"))
    begins = F.transform(F.sequence(F.lit(1), F.least(F.length("_key"), F.lit(longest))), lambda n: F.col("_key").substr(F.lit(1), n))
    keyed = initials.where(F.length("_key") > 0).select("document_id", "document_name", F.explode(begins).alias("key"))
    return keyed.join(wanted.select("key").distinct(), "key")


def existing(requests: DataFrame, stored: DataFrame, *key: str) -> DataFrame:
    """Requests whose key is taken."""
    return requests.join(stored.select(*key), list(key), "left_semi")


def _marked(requests: DataFrame, stored: DataFrame, key: list[str], flag: str) -> DataFrame:
    taken = stored.select(*key).distinct().withColumn(flag, F.lit(True))
    return requests.join(taken, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL")


def _bad_fields() -> Column:
    in_range = F.lit(True)
    for c in VERSION:
        in_range = in_range & F.col(c).between(0, 999)
    return ~F.coalesce(in_range, F.lit(False))


def upload_documents(requests: DataFrame, groups: DataFrame, documents: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New groups with their first document, in order of seq. requests: seq (unique), project_id, category, group_name, major, minor, patch, file_name, hash, size.

    Refused: no_file, bad_fields, no_project, group_exists, same_content; what is refused takes neither a name nor a content.
    """
    rows = _marked(requests, projects, ["project_id"], "_project")
    fields = _bad_fields() | ~F.coalesce(F.length("group_name").between(1, 30) & F.length("category").between(1, 10), F.lit(False))
    rows = rows.withColumn("reason", F.when(_no_file(), "no_file").when(fields, "bad_fields").when(~F.col("_project"), "no_project")).drop("_project")
    name, content = key_of("project_id", "category", "group_name"), _content("hash")
    owned = documents.join(groups.select("group_id", "project_id"), "group_id")
    stored = groups.select(F.concat(F.lit("g"), F.col("group_id").cast("string")).alias("entity"), name.alias("name_key"), F.lit(None).cast("string").alias("content_key"))
    stored = stored.unionByName(owned.select(F.concat(F.lit("d"), F.col("document_id").cast("string")).alias("entity"), F.lit(None).cast("string").alias("name_key"), content.alias("content_key")))
    asked = rows.where("reason IS NULL").select("seq", F.lit(None).cast("string").alias("entity"), name.alias("name_key"), content.alias("content_key"))
    decided, _ = accept_in_order(asked, stored, [Slot("name_key", "group_exists"), Slot("content_key", "same_content")], unchanged=None)
    return _split(_as_document(_with_reasons(rows, decided)))


def upload_versions(requests: DataFrame, groups: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New versions in stored groups, in order of seq. requests: seq (unique), group_id, major, minor, patch, file_name, hash, size. Refused: no_file, bad_fields, no_group, version_exists, same_content."""
    owner = groups.select("group_id", "project_id")
    rows = requests.join(owner, "group_id", "left")
    rows = rows.withColumn("reason", F.when(_no_file(), "no_file").when(_bad_fields(), "bad_fields").when(F.col("project_id").isNull(), "no_group"))
    keys = [key_of("group_id", *VERSION).alias("version_key"), _content("hash").alias("content_key")]
    stored = documents.join(owner, "group_id").select(F.col("document_id").cast("string").alias("entity"), *keys)
    asked = rows.where("reason IS NULL").select("seq", F.lit(None).cast("string").alias("entity"), *keys)
    decided, _ = accept_in_order(asked, stored, [Slot("version_key", "version_exists"), Slot("content_key", "same_content")], unchanged=None)
    return _split(_as_document(_with_reasons(rows, decided)))


def _content(column: str) -> Column:
    """The key of a content in its project."""
    return F.when(F.col(column).isNotNull(), key_of("project_id", column))


def _no_file() -> Column:
    return (F.coalesce(F.col("size"), F.lit(0)) <= 0) | (F.coalesce(F.length("file_name"), F.lit(0)) == 0)


def _with_reasons(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows with the reasons that the order of requests has added."""
    more = decided.select(F.col("seq").alias("_seq"), F.col("reason").alias("_reason"))
    return rows.join(more, F.col("seq") == F.col("_seq"), "left").withColumn("reason", F.coalesce("reason", "_reason")).drop("_seq", "_reason")


def _as_document(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"document_name": file_stem(F.col("file_name")), "extension": file_extension(F.col("file_name")), "version": version_text(*(F.col(c) for c in VERSION))})


def changed_fields(row: str = "", new: str = "new_") -> dict[str, Column]:
    """version, file and processed: whether a request changes it; a request without a file leaves it."""
    version = F.lit(False)
    for c in VERSION:
        version = version | ~F.col(f"{row}{c}").eqNullSafe(F.col(f"{new}{c}"))
    file = F.col(f"{new}hash").isNotNull() & ~F.col(f"{row}hash").eqNullSafe(F.col(f"{new}hash"))
    return {"version": version, "file": file, "processed": ~F.col(f"{row}is_processed").eqNullSafe(F.coalesce(F.col(f"{new}is_processed"), F.lit(False)))}


def update_documents(documents: DataFrame, groups: DataFrame, changes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """All documents after the changes, and the refused changes. changes: seq (unique), document_id, new_major, new_minor, new_patch, new_hash, new_size, new_file_name, new_is_processed.

    Changes count in order of seq, each against what those before it have left: a version or content that one frees can be taken by a later one, of the same document too.
    Refused: not_found, unchanged, version_exists, same_content.
    """
    owner = groups.select("group_id", "project_id")
    owned = documents.join(owner, "group_id")
    news = [f"new_{c}" for c in VERSION]
    asked = changes.join(owned.select("document_id", "group_id", "project_id"), "document_id", "left")
    processed = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("string").alias("processed_key")
    requests = asked.where("group_id IS NOT NULL").select("seq", F.col("document_id").cast("string").alias("entity"), key_of("group_id", *news).alias("version_key"), _content("new_hash").alias("content_key"), processed("new_is_processed"))
    stored = owned.select(F.col("document_id").cast("string").alias("entity"), key_of("group_id", *VERSION).alias("version_key"), _content("hash").alias("content_key"), processed("is_processed"))
    slots = [Slot("version_key", "version_exists"), Slot("content_key", "same_content"), Slot("processed_key")]
    decided, _ = accept_in_order(requests, stored, slots)
    judged = asked.join(decided.select(F.col("seq").alias("_seq"), "reason", "did_content_key"), F.col("seq") == F.col("_seq"), "left")
    reason = F.when(F.col("group_id").isNull(), "not_found").otherwise(F.col("reason"))
    judged = judged.withColumn("reason", reason)
    refused = judged.where("reason IS NOT NULL").select("seq", "document_id", "reason")
    file = F.struct("seq", "new_hash", "new_size", "new_file_name")
    last = judged.where("reason IS NULL").groupBy("document_id").agg(F.max(F.struct("seq", *news, "new_is_processed")).alias("_last"), F.max(F.when(F.col("did_content_key"), file)).alias("_file"))
    rows = documents.join(last, "document_id", "left")
    changed, refile = F.col("_last").isNotNull(), F.col("_file").isNotNull()
    values = {c: F.when(changed, F.col(f"_last.new_{c}")).otherwise(F.col(c)) for c in VERSION}
    values |= {c: F.when(refile, F.col(f"_file.new_{c}")).otherwise(F.col(c)) for c in ("hash", "size")}
    values |= {c: F.when(refile, of(F.col("_file.new_file_name"))).otherwise(F.col(c)) for c, of in (("document_name", file_stem), ("extension", file_extension))}
    values |= {"is_processed": F.when(changed, F.coalesce("_last.new_is_processed", F.lit(False))).otherwise(F.col("is_processed")), "reuploaded_at": F.when(changed, now).otherwise(F.col("reuploaded_at"))}
    return rows.select(*(values.get(c, F.col(c)).alias(c) for c in documents.columns)), refused


def delete_documents(documents: DataFrame, groups: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents without those of ``ids`` (document_id), and the groups without those that this empties."""
    kept = documents.join(ids, "document_id", "left_anti")
    touched = documents.join(ids, "document_id", "left_semi").select("group_id").distinct()
    emptied = touched.join(kept.select("group_id"), "group_id", "left_anti")
    return kept, groups.join(emptied, "group_id", "left_anti")


def empty_groups(groups: DataFrame, documents: DataFrame) -> DataFrame:
    return groups.join(documents.select("group_id"), "group_id", "left_anti")


def relabel_groups(groups: DataFrame, changes: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Groups with a new group_name or category. changes: group_id, new_value, and seq (unique, their order; without it a group has one change at most, and they go by group_id). Refused: not_found, group_exists (the unchanged value too).

    A value that a change frees can be taken by a later one.
    """
    key = ["project_id", "category", "group_name"]
    ordered = changes if "seq" in changes.columns else changes.withColumn("seq", F.col("group_id"))
    asked = ordered.join(groups, "group_id", "left").withColumn(column, F.coalesce("new_value", column))
    requests = asked.where("project_id IS NOT NULL").select("seq", F.col("group_id").cast("string").alias("entity"), key_of(*key).alias("name_key"))
    decided, _ = accept_in_order(requests, groups.select(F.col("group_id").cast("string").alias("entity"), key_of(*key).alias("name_key")), [Slot("name_key", "group_exists", strict=True)])
    judged = _with_reasons(asked.withColumn("reason", F.when(F.col("project_id").isNull(), "not_found")), decided)
    last = judged.where("reason IS NULL").groupBy("group_id").agg(F.max_by("new_value", "seq").alias("_value"))
    rows = groups.join(last, "group_id", "left").withColumn(column, F.coalesce("_value", column)).select(groups.columns)
    return rows, judged.where("reason IS NOT NULL").select("seq", "group_id", "reason")
