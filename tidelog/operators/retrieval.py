"""Retrieval of passages for questions, for the declared document search: BM25, best k of each question, with pruning by upper bounds.

Passages are runs of a document's words. A posting is (term, passage, impact), the impact being the term's whole share of a score, in thousandths and rounded down, so scores are sums of integers and the same in any order. Only postings of terms that
questions have are kept. For each question,

1. its terms of fewest postings give first candidates, and the k-th best of their scores is a threshold that the result cannot fall below;
2. terms are taken by falling greatest impact until what the rest could add together stays below the threshold: passages without any of these essential terms are out, and are never looked at;
3. of a passage that has some, the impacts of the essential terms and the greatest ones that its block of passages has of the others bound its score, and only passages that may reach the threshold are scored in full.

So the result is that of scoring all passages. Everything is joins and partial aggregates by term or passage; a term that very many passages have is hardly ever essential, and its joins are between written tables, which Spark may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import Steps

K1, B = 1.2, 0.75
WORD = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"
#: Postings that the first candidates of a question come from (one term's at least), and passages of a block.
FIRST, BLOCK = 200, 64


def terms_of(text: Column) -> Column:
    """Words, A-Z in lower case; a null text has none."""
    whole = F.coalesce(text, F.lit(""))
    # A text of ASCII only takes the faster way to the same.
    lowered = F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def passages(docs: DataFrame, id_col: str, text_col: str, words: int = 100) -> DataFrame:
    """id_col, passage (its number, from 0), terms: runs of so many words; the last one may be shorter."""
    split = docs.select(id_col, terms_of(F.col(text_col)).alias("_terms"))
    # No filter by the terms before they are dealt out, nor one that Spark would infer from explode: it would have them found twice.
    numbers = F.explode_outer(F.when(F.size("_terms") > 0, F.sequence(F.lit(0), F.floor((F.size("_terms") - 1) / words).cast("int"))))
    return split.select(id_col, "_terms", numbers.alias("passage")).where("passage IS NOT NULL").select(id_col, "passage", F.slice("_terms", F.col("passage") * words + 1, F.lit(words)).alias("terms"))


def _impact(documents: int, terms: int) -> Column:
    idf = F.log(1 + (documents - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return F.floor(1000 * idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / (terms / max(1, documents)))))


def retrieve(found: DataFrame, questions: DataFrame, k: int, id_col: str, question_id: str, question_text: str, trace: dict | None = None) -> DataFrame:
    """question_id, rank, id_col, passage, score: for each question the k passages of highest score above 0, ties by id and number. found: as ``passages`` gives it (ids unique).

    A question's repeated words count once each time. trace: gets the numbers of (question, passage) pairs that share a term, and of those that were scored.
    """
    steps = Steps(found.sparkSession, "retrieval")
    asked = steps.save(questions.select(F.col(question_id).alias("q"), F.explode(terms_of(F.col(question_text))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("times")), "asked")
    # Texts are read and taken apart once: each passage has a row of the empty term too, which no question has, and these rows are what all passages are counted by.
    wanted = asked.select("term").distinct().unionAll(found.sparkSession.createDataFrame([("",)], "term string"))
    dealt = found.select(F.col(id_col).alias("id"), "passage", F.size("terms").alias("n"), F.explode_outer(F.concat("terms", F.array(F.lit("")))).alias("term"))
    every = steps.save(dealt.join(steps.save(wanted, "wanted"), "term", "left_semi").groupBy("id", "passage", "n", "term").agg(F.count("*").alias("tf")), "counted")
    seen = every.where("term = ''").agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    counted = every.where("term != ''")
    held = steps.save(counted.groupBy("term").agg(F.count("*").alias("df")), "held")  # written, so that Spark sees how small it is
    block = F.pmod(F.xxhash64("id", F.floor(F.col("passage") / 8)), F.lit(max(1, seen["n"] // BLOCK))).alias("block")
    postings = steps.save(counted.join(held, "term").select("term", "id", "passage", block, "df", _impact(seen["n"], seen["terms"]).alias("impact")), "postings")
    greatest = postings.groupBy("term").agg(F.max("impact").alias("most"), F.max("df").alias("df"))
    terms = steps.save(asked.join(greatest, "term").withColumn("most", F.col("most") * F.col("times")), "terms")
    blocks = steps.save(postings.groupBy("term", "block").agg(F.max("impact").alias("most")), "blocks")

    def scored(pairs: DataFrame) -> DataFrame:
        """q, id, passage, score of pairs (q, id, passage)."""
        own = pairs.join(postings.select("id", "passage", "term", "impact"), ["id", "passage"]).join(asked, ["q", "term"])
        return own.groupBy("q", "id", "passage").agg(F.sum(F.col("impact") * F.col("times")).alias("score"))

    def best(scores: DataFrame) -> DataFrame:
        order = Window.partitionBy("q").orderBy(F.desc("score"), "id", "passage")
        return scores.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    rarest = Window.partitionBy("q").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    start = terms.where("most > 0").withColumn("before", F.coalesce(F.sum("df").over(rarest), F.lit(0))).where(F.col("before") < FIRST).select("q", "term")
    first = steps.save(scored(steps.save(postings.join(start, "term").select("q", "id", "passage").distinct(), "start")), "first")
    threshold = best(first).groupBy("q").agg(F.when(F.count("*") == k, F.min("score")).otherwise(1).alias("least"))
    # What the terms of smaller greatest impact could add together; those that stay below the threshold are not essential.
    rising = Window.partitionBy("q").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    ranked = terms.join(threshold, "q", "left").withColumn("least", F.coalesce("least", F.lit(1))).withColumn("essential", F.sum("most").over(rising) >= F.col("least"))
    others = F.coalesce(F.sum(F.when(~F.col("essential"), F.col("most"))).over(Window.partitionBy("q")), F.lit(0))
    ranked = steps.save(ranked.withColumn("others", others).select("q", "term", "times", "least", "essential", "others"), "ranked")
    partial = postings.join(ranked.where("essential"), "term").groupBy("q", "id", "passage", "block").agg(F.sum(F.col("impact") * F.col("times")).alias("sure"), F.max("least").alias("least"), F.max("others").alias("others"))
    partial = partial.where(F.col("sure") + F.col("others") >= F.col("least")).drop("others")  # by what the others have anywhere, before it is looked up by block
    rest = blocks.join(ranked.where("NOT essential"), "term").groupBy("q", "block").agg(F.sum(F.col("most") * F.col("times")).alias("rest"))
    may = partial.join(rest, ["q", "block"], "left").where(F.col("sure") + F.coalesce("rest", F.lit(0)) >= F.col("least")).select("q", "id", "passage")
    fresh = steps.save(may.join(first.select("q", "id", "passage"), ["q", "id", "passage"], "left_anti"), "fresh")
    if trace is not None:
        trace |= {"all": postings.join(asked, "term").select("q", "id", "passage").distinct().count(), "scored": first.count() + fresh.count()}
    result = best(first.unionByName(scored(fresh)))
    return result.select(F.col("q").alias(question_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "passage", "score")
