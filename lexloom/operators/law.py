"""Citations resolved to provisions, documents segmented and read, provision trees, amendments detected and replayed into versions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import amend, html, legal
from ..functions.text import normalise_text
from ..session import cut
from .amendments import review_status
from .folds import arrow_udf, folded

LOCATOR = "struct<path: string, relative: boolean, instrument: string>"
NUMBERED = "array<struct<kind: string, value: string>>"

citations_of = arrow_udf(legal.citations, legal.CITATION)
locator_of = arrow_udf(legal.locator, LOCATOR)
numbering_of = arrow_udf(lambda t: legal.numbering(t or ""), NUMBERED)
html_blocks_of = arrow_udf(html.blocks, html.BLOCK)
cited = arrow_udf(legal.looks_like_citation, "boolean")


def citations(texts: DataFrame, *keys: str) -> DataFrame:
    """A row for each citation in each text."""
    return texts.select(*keys, F.explode(citations_of("text")).alias("c")).select(*keys, "c.*")


def mentions(found: DataFrame, provisions: DataFrame, *keys: str) -> DataFrame:
    """Citations joined to provisions by instrument and path without chapter, once for each provision and place."""
    canonical = F.regexp_replace("path", r"^ch[0-9]+\.", "")
    targets = provisions.select("provision_id", "instrument", canonical.alias("path")).groupBy("instrument", "path").agg(F.min("provision_id").alias("provision_id"))
    return found.where("path is not null and instrument is not null").join(targets, ["instrument", "path"]).select(*keys, "provision_id").distinct()


def html_blocks(pages: DataFrame, key: str) -> DataFrame:
    return pages.select(key, F.posexplode(html_blocks_of("html")).alias("seq", "b")).select(key, "seq", "b.*")


def classified(blocks: DataFrame, key: str) -> DataFrame:
    """Each document's type by the first cue in its first blocks; of cues at one place the first in the list. All in SQL functions."""
    most = max(cue[3] for cue in legal.CUES)
    first = blocks.where(F.col("seq") < most).withColumn("text", normalise_text("text"))
    rows = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("texts"))
    at = [F.regexp_instr(F.array_join(F.slice("texts", 1, window), "\n"), F.lit(pattern)) for *_, window, pattern in legal.CUES]
    told = F.array(*[F.struct(place.alias("place"), F.lit(k).alias("priority"), F.lit(kind).alias("doc_type"), F.lit(name).alias("cue"), F.lit(rank).alias("authority_rank")) for k, (place, (name, kind, rank, *_)) in enumerate(zip(at, legal.CUES, strict=True))])
    return rows.select(key, F.array_min(F.filter(told, lambda x: x["place"] > 0)).alias("c")).select(key, "c.doc_type", "c.cue", "c.authority_rank")


def carried(blocks: DataFrame, key: str, marker: Column, empty: str) -> DataFrame:
    """blocks with `path`: the last marker seen in the document, `empty` before the first."""
    order = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("path", F.coalesce(F.last(marker, ignorenulls=True).over(order), F.lit(empty)))


def provision_tree(blocks: DataFrame, key: str) -> DataFrame:
    """blocks (key, seq, path, text) as provisions: text of equal paths joined, missing ancestors added, siblings counted."""
    own = blocks.groupBy(key, "path").agg(F.min("seq").alias("first_seq"), F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("parts"))
    own = own.select(key, "path", "first_seq", F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("text"))
    steps = F.split("path", r"\.")
    above = own.select(key, "first_seq", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "."))).alias("path"))
    nodes = above.groupBy(key, "path").agg(F.min("first_seq").alias("first_seq"))
    parts = F.split("path", r"\.")
    nodes = nodes.withColumn("parent", F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "."))).withColumn("depth", F.size(parts) - 1)
    ordinal = F.row_number().over(Window.partitionBy(key, "parent").orderBy("first_seq", "path"))
    return nodes.withColumn("ordinal", ordinal).join(own.select(key, "path", "text"), [key, "path"], "left").withColumn("synthesised", F.col("text").isNull())


#: How each step of a law's path looks.
STEPS = r"ch\d+|[sr]\d+[A-Z]*|\d+[A-Z]*|[a-z]{1,4}|prov\d+|expl\d+|sched\d+|form\d+|annex\d+|toc|pre|fn\d+"


def skipped_paths(blocks: DataFrame) -> DataFrame:
    """(token, n): steps of paths that no provision can have, with the number of blocks they are in."""
    bad = F.filter(F.split("path", r"\."), lambda x: ~x.rlike(f"^(?:{STEPS})$"))
    return blocks.select(F.explode(F.array_distinct(bad)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- amendments


def _applied(text, op, kind, old_text, new_text, anchor_text, position):
    if f"{op}_{kind}" not in amend.RULES:
        return None, "no_operation"
    return amend.applied(text, {"kind": f"{op}_{kind}", "old_text": old_text, "new_text": new_text, "anchor_text": anchor_text, "position": position})


applied = arrow_udf(_applied, "struct<text: string, reason: string>")


def tried(found: DataFrame, provisions: DataFrame, versions: DataFrame, key: str, on: Column) -> DataFrame:
    """Proposals with their target, a dry run on its text, and the review they need.

    The provision looked up is the one that changes, or the neighbour of one that is inserted; one hit resolves it, none is
    not_found, more are ambiguous. The text is the version that stands on a day, else the latest one.
    """
    looked = F.when((F.col("op") == "insert") & (F.col("kind") == "provision"), F.col("anchor_path")).otherwise(F.col("target_path"))
    targets = provisions.select("provision_id", "instrument", F.regexp_replace("path", r"^ch[0-9]+\.", "").alias("path")).groupBy("instrument", "path").agg(F.count("*").alias("hits"), F.min("provision_id").alias("provision_id"))
    rows = found.withColumn("path", looked).join(targets, ["instrument", "path"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    rows = rows.withColumn("outcome", F.when(F.col("hits") == 0, "not_found").when(F.col("hits") == 1, "resolved").otherwise("ambiguous")).withColumn("provision_id", F.when(F.col("hits") == 1, F.col("provision_id")))
    stands = (F.col("valid_from") <= on) & (F.col("valid_to").isNull() | (F.col("valid_to") > on))
    texts = versions.groupBy("provision_id").agg(F.max_by("text", F.struct(stands, "valid_from")).alias("standing"))
    rows = rows.join(texts, "provision_id", "left")
    new = (F.col("op") == "insert") & (F.col("kind") == "provision")
    dry = F.when((F.col("status") == "parsed") & (F.col("hits") == 1), applied(F.when(~new, F.col("standing")), "op", "kind", "old_text", "new_text", "anchor_text", "position"))
    return rows.withColumn("dry", dry).select(
        key, "place", "status", "op", "kind", "instrument", "target_path", "provision_id", "outcome", "effective_from", "condition",
        (F.col("dry").isNotNull() & F.col("dry.reason").isNull()).alias("dry_run_ok"), F.col("dry.reason").alias("dry_run_reason"), review_status(F.col("status"), F.col("problems"), F.col("hits") == 1).alias("review_status"),
    )


VERSION = "provision_id long, valid_from date, valid_to date, text string, amendment_id string, problem string"


def replayed(baselines: DataFrame, steps: DataFrame) -> DataFrame:
    """Versions of each provision, and its problems (rows with `problem`): its baseline with its steps applied in order.

    baselines (provision_id, base_text, base_from); steps (provision_id, amendment_id, effective_from, kind, old_text, new_text,
    anchor_text, position, occurrence). A provision's rows stream through its fold, the baseline first, so neither its
    text nor its steps are ever gathered.
    """
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    words = ("kind", "old_text", "new_text", "anchor_text", "position")
    base = baselines.select("provision_id", F.lit(0).alias("rank"), F.col("base_from").alias("day"), *none("amendment_id"), F.col("base_text").alias("text"), *none(*words), F.lit(None).cast("int").alias("occurrence"))
    more = steps.select("provision_id", F.lit(1).alias("rank"), F.col("effective_from").alias("day"), "amendment_id", *none("text"), *words, F.col("occurrence").cast("int").alias("occurrence"))

    def body(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        first = next(rows)
        text, since = (first[4], first[2]) if first[1] == 0 else (None, None)
        todo = (r for part in ([] if first[1] == 0 else [first], rows) for r in part)
        names = ("kind", "old_text", "new_text", "anchor_text", "position", "occurrence")
        ops = (amend.Step(r[2], (), r[3], dict(zip(names, r[5:], strict=True))) for r in todo)
        for got in amend.replay(text, since, ops):
            yield (key[0], *got, None) if isinstance(got, amend.Version) else (key[0], None, None, None, got[0], got[1])

    return folded(base.unionByName(more), ["provision_id"], ["rank", "day", "amendment_id"], body, VERSION)


def consolidation(active: DataFrame, planned: DataFrame) -> DataFrame:
    """(provision_id, action): whether the active versions of a provision are the planned ones, or all are to be replaced."""
    digest = lambda df, name: df.groupBy("provision_id").agg(F.md5(F.to_json(F.array_sort(F.collect_list(F.struct("valid_from", "valid_to", "text"))))).alias(name))
    both = digest(active, "a").join(digest(planned.where("problem is null"), "p"), "provision_id", "full_outer")
    return both.select("provision_id", F.when(F.col("p").isNull(), "close").when(F.col("a").isNull(), "insert").when(F.col("a") == F.col("p"), "unchanged").otherwise("replace").alias("action"))


def consolidated(stored: DataFrame, planned: DataFrame, at: Column) -> DataFrame:
    """The next snapshot of stored versions (.., rec_from, rec_to): where a provision's plan differs, its open rows closed on record and the planned ones added."""
    names = ["provision_id", "valid_from", "valid_to", "text", "amendment_id", "rec_from", "rec_to"]
    actions = cut(consolidation(stored.where("rec_to is null"), planned))
    kept = stored.join(actions, "provision_id", "left")
    ends = F.when(F.col("rec_to").isNull() & F.col("action").isin("close", "replace"), at).otherwise(F.col("rec_to"))
    added = planned.where("problem is null").join(actions.where("action in ('insert', 'replace')"), "provision_id")
    return kept.withColumn("rec_to", ends).select(*names).unionByName(added.withColumn("rec_from", at).withColumn("rec_to", F.lit(None).cast(stored.schema["rec_to"].dataType)).select(*names))


#: The link that a consolidated operation leaves between its document and the provision.
LINK_TYPES = {"substitute": "substitutes", "insert": "inserts", "omit": "omits"}


def amendment_links(planned: DataFrame, amendments: DataFrame, stored: DataFrame) -> DataFrame:
    """Links (src_id, dst_id, link_type) of amendments (amendment_id, doc_id, op) that made a version and are not stored yet."""
    kinds = F.create_map(*[F.lit(x) for kv in LINK_TYPES.items() for x in kv])
    made = planned.where("amendment_id is not null and problem is null").join(amendments, "amendment_id")
    links = made.select(F.col("doc_id").alias("src_id"), F.col("provision_id").alias("dst_id"), F.coalesce(F.try_element_at(kinds, F.col("op")), F.lit("amends")).alias("link_type")).distinct()
    return links.join(stored, ["src_id", "dst_id", "link_type"], "left_anti")


def resolved(found: DataFrame, provisions: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """The first citation of each text with the provision or document it names; nothing named is `not_found`."""
    first = found.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.when(F.col("kind") == "section", 0).when(F.col("kind") == "rule", 1).otherwise(2), "start"))).where("n = 1")
    a = first.join(provisions.select("instrument", "path", "provision_id"), ["instrument", "path"], "left").join(documents.select("canonical_id", "doc_id"), "canonical_id", "left")
    return a.select(key, "kind", "canonical_id", F.coalesce("provision_id", "doc_id").alias("entity"), F.when(F.coalesce("provision_id", "doc_id").isNotNull(), "matched").when(F.col("ambiguous"), "ambiguous").otherwise("not_found").alias("outcome"))
