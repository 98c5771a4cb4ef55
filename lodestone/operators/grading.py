"""Of which grade a set of evidence is: production only if all nine conditions hold (FLT-16). What is null doesn't hold.

sets: set, mode, as_of, schema, algorithm, fingerprint (of what ran), dev_override, role, user, embedder (production: whether it is a real
implementation; grade, model_id, provider, model, version, dimensions), active (model_id, provider, model, version, dimensions),
reranker (production, grade, id, version) and configuration (status, ready, not_ready: what it lacks, approved, tier, model_id, reranker_id,
reranker_version, fingerprint, algorithm, chunkers, scope: product and type that were evaluated). items: set, document, version, status,
withdrawn, authoritative, valid_from, valid_to, temporal_status, chunker, product, document_type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.columns import holds
from lodestone.operators.access import production_grade

#: The schema of sets, and the identity of no reranker.
SCHEMA, NONE = 2, "none"


def graded(sets: DataFrame, items: DataFrame) -> DataFrame:
    """(set, grade, unmet): the grade, and the names of the conditions that don't hold, in order."""
    c, e, m, r = (lambda x: F.col(f"configuration.{x}")), (lambda x: F.col(f"embedder.{x}")), (lambda x: F.col(f"active.{x}")), (lambda x: F.col(f"reranker.{x}"))
    alike = (e("model_id") == m("model_id")) & (e("provider") == m("provider")) & (e("model") == m("model")) & (e("version") == m("version")) & (e("dimensions") == m("dimensions"))
    # What a set tells by itself is settled before it meets its items: joins carry truth values, not what they were made of.
    alone = {
        "P1": e("production") & (e("grade") == "production") & alike & (c("model_id") == m("model_id")),
        "P2": r("production") & (r("grade") == "production") & (r("id") != NONE) & (r("id") == c("reranker_id")) & (r("version") == c("reranker_version")),
        "P3": (c("status") == "active") & c("ready") & (F.size(c("not_ready")) == 0) & c("approved"),
        "P4": F.col("fingerprint") == c("fingerprint"),
        "P5": F.lit(True),
        "P6": (F.col("role") == "authenticated") & F.col("user").isNotNull(),
        "P7": F.col("configuration").isNotNull(),
        "P8": ~F.col("dev_override"),
        "P9": (F.col("schema") == SCHEMA) & c("fingerprint").rlike("^[0-9a-f]{64}$") & (c("algorithm") == F.col("algorithm")),
    }
    s = sets.select("set", *[F.coalesce(rule, F.lit(False)).alias(name) for name, rule in alone.items()])
    s = s.select("set", F.array(*alone).alias("alone"))
    asked = sets.select("set", (~F.coalesce(F.col("mode") != "current", F.lit(False))).alias("now"), "as_of", c("chunkers").alias("chunkers"), c("scope").alias("scope"), c("tier").eqNullSafe(F.lit("standard")).alias("standard"))
    sound = (F.col("status") == "published") & ~F.col("withdrawn") & F.col("authoritative") & (F.col("temporal_status") != "future")
    told = items.select("set", F.coalesce(sound, F.lit(False)).alias("sound"), (F.col("temporal_status") == "current").alias("current"), "valid_from", "valid_to", "chunker", "product", "document_type")

    def every(rule: Column, name: str) -> Column:
        return F.bool_and(F.coalesce(rule, F.lit(False))).alias(name)

    same_type = F.col("document_type")
    covered = F.exists("scope", lambda x: (x["type"] == same_type) & (F.col("standard") | (x["product"] == F.col("product"))))
    valid = F.col("sound") & holds("valid_from", "valid_to", F.col("as_of")) & (~F.col("now") | F.col("current"))
    seen = told.join(asked, "set").groupBy("set").agg(every(covered, "covered"), every(valid, "valid"), every(F.array_contains("chunkers", F.col("chunker")), "evaluated"))
    mixed = items.groupBy("set", "document").agg(F.min("version").alias("least"), F.max("version").alias("most")).filter("least <> most").select("set", F.lit(True).alias("mixed")).distinct()
    s = s.join(seen, "set", "left").join(mixed, "set", "left")
    none = F.lit(True)  # a set without items
    more = {"P3": F.coalesce("covered", none), "P5": F.coalesce("valid", none) & F.col("mixed").isNull(), "P7": F.coalesce("evaluated", none)}
    conditions = [(name, F.col("alone")[i] & more.get(name, none)) for i, name in enumerate(alone)]
    return s.select("set", production_grade(conditions).alias("g")).select("set", "g.grade", "g.unmet")
