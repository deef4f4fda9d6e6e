"""Delivery of code by ref: a ref is found again in today's text, widened or narrowed, and cut out.

Refs resolve in tiers: by name, among several of one name by signature or by the nearest line, after
a change of name by the body, else by the lines that were stored. All refs are resolved at once by
joins on (repository, path, name); the text of a file meets its refs on (repository, path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T

#: How a span may be widened.
EXPAND = ("exact", "neighbors", "parent", "file", "block")


def complete_units(cards: DataFrame) -> DataFrame:
    """``cards`` with ``is_complete, safe, parent``: a card without statement is complete; only complete
    ones are safe to reason from alone; ``parent`` is the ref of the unit around a partial one."""
    whole = F.coalesce(F.col("is_complete_unit"), F.lit(1)) != 0
    return cards.withColumn("is_complete", whole).withColumn("safe", whole).withColumn("parent", F.when(~whole, F.col("parent_ref")))


def upgraded(cards: DataFrame) -> DataFrame:
    """Each card with the card to deliver for it, ``asked, note`` and the columns of that card: its
    parent for a partial unit whose parent is a card too, unless ``expand`` is block.

    ``cards`` has ``repo_id, ref, is_complete_unit, unit_kind, parent_ref, expand`` and the hints of
    ``resolve_spans``; several cards of one ref count as parents by the least id.
    """
    hints = [c for c in cards.columns if c not in ("repo_id", "expand", "view")]
    parents = cards.groupBy("repo_id", F.col("ref").alias("parent_ref")).agg(F.min_by(F.struct(*hints), "id").alias("up"))
    joined = complete_units(cards).join(parents, ["repo_id", "parent_ref"], "left")
    use = ~F.col("is_complete") & F.col("up").isNotNull() & (F.col("expand") != "block")
    note = F.when(use, F.concat(F.lit("auto-expanded from partial block "), "ref", F.lit(" to complete unit "), "parent_ref")).when(
        ~F.col("is_complete"),
        F.concat(F.lit("partial unit ("), F.coalesce("unit_kind", F.lit("None")), F.lit(") — not safe to reason from alone"), F.coalesce(F.concat(F.lit(" (parent: "), "parent_ref", F.lit(")")), F.lit(""))),
    )
    own = [F.when(use, F.col("up")[c]).otherwise(F.col(f"`{c}`")).alias(c) for c in hints]
    return joined.select("repo_id", F.col("ref").alias("asked"), F.col("id").alias("asked_id"), note.alias("note"), F.when(use, F.lit("exact")).otherwise(F.col("expand")).alias("expand"), "view", *own)


def resolve_spans(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """``refs`` with ``how, found_id, first, last, hash_then, ambiguous`` (null ``how``: nothing found).

    ``refs`` has a key ``n``, ``repo_id, path, q`` (the qualified name, null for refs to lines or files),
    ``is_file, start_line, end_line, signature_hash, content_hash, fingerprint``. ``symbols`` are
    those of today with ``repo_id, path, qualified_name, start_line, end_line`` and their hashes.
    """
    s = symbols.select(
        "repo_id", "path", F.replace("qualified_name", F.lit("::"), F.lit(".")).alias("q"), F.col("id").alias("sid"), F.col("start_line").alias("a"),
        F.col("end_line").alias("b"), F.col("signature_hash").alias("sh"), F.col("fingerprint").alias("fp"),
    )
    hits = refs.where("q IS NOT NULL").select("n", "repo_id", "path", "q", "signature_hash", "start_line").join(s, ["repo_id", "path", "q"])
    same = F.coalesce(F.col("sh") == F.col("signature_hash"), F.lit(False))
    # Those of the same signature come before all others, the nearest before the farther.
    order = F.struct((~same).cast("int"), F.coalesce(F.abs(F.col("a") - F.col("start_line")), F.col("a")), "a", "sid")
    by = hits.groupBy("n").agg(F.count(F.lit(1)).alias("k"), F.count_if(same).alias("k_same"), F.min_by(F.struct("sid", "a", "b"), order).alias("h"))
    bodies = s.where("fp IS NOT NULL").groupBy("repo_id", "path", F.col("fp").alias("fingerprint")).agg(F.count(F.lit(1)).alias("k_body"), F.min(F.struct("sid", "a", "b")).alias("moved"))
    joined = refs.join(by, "n", "left").join(bodies.where("k_body = 1"), ["repo_id", "path", "fingerprint"], "left")
    named, lined = F.col("q").isNotNull(), F.col("start_line").isNotNull() & F.col("end_line").isNotNull()
    how = (
        F.when(~named & F.col("is_file"), "file")
        .when(~named & lined, "code")
        .when(named & (F.col("k") == 1), "qname")
        .when(named & (F.col("k") > 1) & (F.col("k_same") == 1), "signature")
        .when(named & (F.col("k") > 1), "qname")
        .when(named & F.col("moved").isNotNull(), "fingerprint")
        .when(named & lined, "line")
    )
    pick = lambda f: F.when(F.col("k") >= 1, F.col("h")[f]).when(named & F.col("moved").isNotNull(), F.col("moved")[f])
    return joined.select(
        *[F.col(f"`{c}`") for c in refs.columns], how.alias("how"), pick("sid").alias("found_id"), F.when(how != "file", F.coalesce(pick("a"), "start_line")).alias("first"),
        F.when(how != "file", F.coalesce(pick("b"), "end_line")).alias("last"), F.coalesce((F.col("k") > 1) & (F.col("k_same") != 1), F.lit(False)).alias("ambiguous"),
    )


def _signature_end(lines: Column, first: Column, last: Column) -> Column:
    """The first line of a span that opens a body; the first line if none does."""
    opens = F.filter(F.sequence(first, F.greatest(first, last)), lambda i: F.element_at(lines, i).contains("{") | F.element_at(lines, i).rlike(r":\s*$"))
    return F.coalesce(F.try_element_at(opens, F.lit(1)), first)


def deliver(cards: DataFrame, texts: DataFrame, symbols: DataFrame, neighbors: int = 8, max_lines: int = 1200) -> DataFrame:
    """The code of each card: ``asked_id, asked, ref, how, start_line, end_line, stale, ambiguous,
    safe, truncated, note, code``.

    ``cards`` has ``id, repo_id, path, ref, q, is_file, start_line, end_line, signature_hash,
    content_hash, fingerprint, is_complete_unit, unit_kind, parent_ref`` and how it is asked for:
    ``expand`` (one of EXPAND, others count as exact) and ``view`` (full, signature, head:N, lines:A-B;
    others count as full). ``texts`` has ``repo_id, path, text``. ``stale`` says that the text differs
    from the hash that was stored, or that only the stored lines were left to go by. Cards whose
    file is gone, and names that are found by nothing, have a null ``how`` and no code.
    """
    asked = upgraded(cards).withColumn("n", F.xxhash64("asked_id", "expand", "view"))
    found = resolve_spans(asked, symbols)
    above = symbols.select("repo_id", "path", F.replace("qualified_name", F.lit("::"), F.lit(".")).alias("q_above"), F.struct("start_line", "end_line").alias("span"))
    around = above.groupBy("repo_id", "path", "q_above").agg(F.min("span").alias("around"))
    with_parent = found.withColumn("q_above", F.nullif(F.regexp_extract("q", r"^(.*)\.[^.]*$", 1), F.lit(""))).join(around, ["repo_id", "path", "q_above"], "left")
    lines = texts.groupBy("repo_id", "path").agg(F.min("text").alias("text")).select("repo_id", "path", T.lines_of(F.col("text")).alias("lines"))
    j = with_parent.join(lines, ["repo_id", "path"], "left").withColumn("total", F.greatest(F.size("lines"), F.lit(1)))
    here = F.col("lines").isNotNull() & F.col("how").isNotNull()
    first, last = F.coalesce("first", F.lit(1)), F.coalesce("last", "total")
    sure = F.col("how").isin("qname", "signature")
    changed = sure & F.col("content_hash").isNotNull() & (F.sha2(T.line_slice(F.col("lines"), first, last), 256) != F.col("content_hash"))
    j = j.withColumn("stale", F.coalesce(changed, F.lit(False)) | (F.col("how") == "line"))
    to_parent = (F.col("expand") == "parent") & F.col("how").isin("qname", "signature", "fingerprint")
    a = F.when(to_parent & F.col("q_above").isNull(), F.lit(1)).when(to_parent & F.col("around").isNotNull(), F.col("around.start_line")).otherwise(first)
    b = F.when(to_parent & F.col("q_above").isNull(), F.col("total")).when(to_parent & F.col("around").isNotNull(), F.col("around.end_line")).otherwise(last)
    j = j.withColumn("a", F.greatest(F.lit(1), F.least(a, "total"))).withColumn("b", F.greatest(F.col("a"), F.least(b, "total")))
    near, whole = F.col("expand") == "neighbors", F.col("expand") == "file"
    j = j.select(
        "*", F.when(whole, F.lit(1)).when(near, F.greatest(F.lit(1), F.col("a") - neighbors)).otherwise(F.col("a")).alias("x"),
        F.when(whole, F.col("total")).when(near, F.least("total", F.col("b") + neighbors)).otherwise(F.col("b")).alias("y"),
    )
    number = lambda pattern, g: F.nullif(F.regexp_extract("view", pattern, g), F.lit("")).cast("int")
    head, v1, v2 = number(r"^head:(\d+)$", 1), number(r"^lines:(\d+)-(\d+)$", 1), number(r"^lines:(\d+)-(\d+)$", 2)
    within = lambda c: F.greatest(F.col("x"), F.least(c, F.col("y")))
    start = F.when(v1.isNotNull(), within(F.least(v1, v2))).otherwise(F.col("x"))
    end = (
        F.when(F.col("view") == "signature", _signature_end(F.col("lines"), F.col("x"), F.col("y")))
        .when(head.isNotNull(), F.least("y", F.col("x") + F.greatest(F.lit(1), head) - 1))
        .when(v1.isNotNull(), within(F.greatest(v1, v2)))
        .otherwise(F.col("y"))
    )
    j = j.withColumn("start", F.when(here, start)).withColumn("end", F.when(here, end))
    over = F.when(here, F.greatest(F.lit(0), F.col("end") - F.col("start") + 1 - max_lines))
    j = j.withColumn("truncated", over).withColumn("end", F.col("end") - over)
    complete = F.coalesce(F.col("is_complete_unit"), F.lit(1)) != 0
    return j.select(
        "asked_id", "asked", "ref", F.when(here, F.col("how")).alias("how"), F.col("start").alias("start_line"), F.col("end").alias("end_line"),
        F.when(here, F.col("stale")).alias("stale"), "ambiguous", complete.alias("safe"), "truncated", "note", F.when(here, T.line_slice(F.col("lines"), F.col("start"), F.col("end"))).alias("code"),
    )
