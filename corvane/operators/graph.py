"""The relationship graph: call edges, their resolution to symbols, callers, impact.

Edges are names until they are resolved, within the repository and the language of the caller.
Symbols are reduced to classes first: for each rule by which a call may name them, one row for each
key with the number of symbols behind it. An edge looks up the classes of its rules, and the first
that exists settles it: one symbol is the target, several make the edge ambiguous. An ambiguous
edge stays one row with the key of its class, however many symbols bear the name; only classes below
the collision threshold of their repository are ever expanded into pairs, since beyond it a name
tells nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.session import checkpointed

#: Words before a bracket that are no calls.
NO_CALLS = (
    "if for while switch catch return function def elif except with match case sizeof lock using foreach nameof typeof "
    "func new throw await super and or not in is lambda print assert del raise yield"
).split()
CALL = r"((?:[A-Za-z_]\w*(?:\.|::|->))?[A-Za-z_]\w*)\("
#: At least this confidence makes a caller certain; at least the second makes it possible.
CONFIDENT, POSSIBLE = 0.6, 0.4


def call_edges(symbols: DataFrame, bodies: DataFrame) -> DataFrame:
    """``source_id, receiver, kind, name`` of each call in a body, each once.

    ``bodies`` has ``symbol_id, content``. The receiver is what stands before ``.``, ``::`` or
    ``->``; its kind is self, this, qualified, name or bare. The definition's own name is no call.
    """
    found = bodies.select("symbol_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(CALL), F.lit(1)))).alias("call"))
    parts = F.regexp_replace("call", r"::|->", ".")
    receiver = F.when(F.contains(parts, F.lit(".")), F.substring_index(parts, ".", 1))
    edges = found.select(F.col("symbol_id").alias("source_id"), receiver.alias("receiver"), F.substring_index(parts, ".", -1).alias("name"), F.contains("call", F.lit("::")).alias("scoped"))
    kind = F.when(F.col("receiver").isNull(), "bare").when(F.col("receiver") == "self", "self").when(F.col("receiver") == "this", "this").when(F.col("scoped"), "qualified").otherwise("name")
    own = normalized(symbols).select(F.col("id").alias("source_id"), F.col("name").alias("own"))
    named = edges.where(~F.col("name").isin(*NO_CALLS)).join(own, "source_id")
    return named.where((F.col("name") != F.col("own")) | F.col("receiver").isNotNull()).select("source_id", "receiver", kind.alias("kind"), "name").distinct()


def normalized(symbols: DataFrame) -> DataFrame:
    """Symbols with what calls are resolved by: ``qname`` with dots, ``name``, its last part, ``owner``,
    what stands before it, ``parent``, the last part of that, and ``stem`` of the file."""
    q = F.replace(F.coalesce("qualified_name", "name"), F.lit("::"), F.lit("."))
    owner = F.nullif(F.regexp_extract(q, r"^(.*)\.[^.]*$", 1), F.lit(""))
    return symbols.select(
        "id", "repo_id", "file_id", F.coalesce("language", F.lit("")).alias("language"), "path", q.alias("qname"), F.substring_index(q, ".", -1).alias("name"),
        owner.alias("owner"), F.substring_index(owner, ".", -1).alias("parent"),
        F.regexp_extract(F.substring_index("path", "/", -1), r"^(.*?)(?:\.[^.]*)?$", 1).alias("stem"),
    )


#: Rules in the order in which they are tried: what they are called, how certain a single hit is, and
#: each of several.
RULES = (("class", 0.9, 0.9), ("scope", 0.8, 0.4), ("module", 0.8, 0.4), ("file", 0.8, 0.4), ("name", 0.6, 0.35))


def _key(rule: str, *parts: Column | str) -> Column:
    """The key of a class; null if a part is."""
    return F.concat(F.lit(rule), *[F.concat(F.lit("\x01"), F.col(p) if isinstance(p, str) else p) for p in parts])


def class_keys(symbols: DataFrame) -> DataFrame:
    """``key, id``: the classes that each symbol is in, one for each rule."""
    keys = F.array(
        _key("class", "repo_id", "language", "qname"), _key("scope", "repo_id", "language", "parent", "name"), _key("module", "repo_id", "language", "stem", "name"),
        _key("file", "repo_id", "language", "file_id", "name"), _key("name", "repo_id", "language", "name"),
    )
    return normalized(symbols).select("id", F.explode(keys).alias("key")).where("key IS NOT NULL")


def resolve_calls(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """``source_id, name, receiver, kind, rule, key, target_id, n_candidates, confidence, ambiguous``
    of each edge that resolves, one row an edge.

    Rules in order: the caller's own class (self, this), a scope, a module of that stem, the
    caller's own file, the name alone. One hit is the target; of several in the caller's class the
    least id is, by every other rule they make the edge ambiguous, and ``target_id`` is null. Names of
    other repositories or languages are never hits.
    """
    s = normalized(symbols)
    classes = class_keys(symbols).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    caller = s.select(F.col("id").alias("source_id"), "repo_id", F.col("language"), "file_id", F.col("owner"))
    e = edges.join(caller, "source_id")
    kind = F.col("kind")
    tried = F.array(
        F.when(kind.isin("self", "this"), _key("class", "repo_id", "language", F.concat("owner", F.lit("."), "name"))),
        F.when(kind == "qualified", _key("scope", "repo_id", "language", "receiver", "name")),
        F.when(kind == "name", _key("module", "repo_id", "language", "receiver", "name")),
        F.when(kind == "bare", _key("file", "repo_id", "language", "file_id", "name")),
        _key("name", "repo_id", "language", "name"),
    )
    asked = e.select("source_id", "name", "receiver", "kind", F.posexplode(tried).alias("order", "key")).where("key IS NOT NULL")
    first = asked.join(classes, "key").groupBy("source_id", "name", "receiver", "kind").agg(F.min(F.struct("order", "key", "n", "least")).alias("h"))
    several = (F.col("h.n") > 1) & (F.col("h.order") > 0)
    look = lambda at: F.element_at(F.array(*[F.lit(r[at]) for r in RULES]), F.col("h.order") + 1)
    return first.select(
        "source_id", "name", "receiver", "kind", look(0).alias("rule"), F.col("h.key").alias("key"), F.when(~several, F.col("h.least")).alias("target_id"),
        F.col("h.n").alias("n_candidates"), F.when(several, look(2)).otherwise(look(1)).alias("confidence"), several.alias("ambiguous"),
    )


def collision_threshold(symbols: DataFrame) -> DataFrame:
    """``repo_id, threshold``: from how many symbols of one name on a name tells nothing, the 90th
    percentile of the sizes of shared names in a repository, at least 8; 2^30 if no name is shared."""
    s = normalized(symbols)
    sizes = s.groupBy("repo_id", "language", "name").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    by_size = sizes.groupBy("repo_id", "n").agg(F.count(F.lit(1)).alias("c"))  # few different sizes a repository
    w = W.partitionBy("repo_id")
    running = by_size.withColumn("total", F.sum("c").over(w)).withColumn("upto", F.sum("c").over(w.orderBy("n")))
    at = F.least(F.col("total") - 1, F.floor(F.col("total") * 9 / 10))
    found = running.where(F.col("upto") > at).groupBy("repo_id").agg(F.greatest(F.lit(8), F.min("n")).alias("threshold"))
    return s.select("repo_id").distinct().join(found, "repo_id", "left").select("repo_id", F.coalesce("threshold", F.lit(1 << 30)).cast("bigint").alias("threshold"))


def split_ambiguous(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """Ambiguous edges with ``suppressed``: whether their name is shared by as many symbols as the
    threshold of the repository, so that it tells nothing."""
    s = normalized(symbols)
    shared = s.groupBy("repo_id", "language", "name").agg(F.count(F.lit(1)).alias("collisions"))
    caller = s.select(F.col("id").alias("source_id"), "repo_id", "language")
    many = resolved.where("ambiguous").join(caller, "source_id").join(shared, ["repo_id", "language", "name"]).join(collision_threshold(symbols), "repo_id")
    return many.withColumn("suppressed", F.col("collisions") >= F.col("threshold"))


def suppressed_callees(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """``source_id, n_listed, n_suppressed, n_names, examples``: of the symbols that a caller may mean
    by ambiguous calls, how many are worth listing, how many are not, the number of names of the
    latter, and three of these, the most shared first."""
    e = split_ambiguous(resolved, symbols)
    # The caller itself may be among the candidates; it is not its own callee.
    own = class_keys(symbols).select("key", F.col("id").alias("source_id"), F.lit(1).alias("own"))
    counted = e.join(own, ["key", "source_id"], "left").withColumn("n", F.col("n_candidates") - F.coalesce("own", F.lit(0)))
    names = counted.groupBy("source_id", "name", "suppressed").agg(F.sum("n").alias("n"), F.max("collisions").alias("collisions"))
    gone = F.col("suppressed")
    each = names.groupBy("source_id").agg(
        F.coalesce(F.sum(F.when(~gone, F.col("n"))), F.lit(0)).alias("n_listed"), F.coalesce(F.sum(F.when(gone, F.col("n"))), F.lit(0)).alias("n_suppressed"),
        F.count_if(gone).alias("n_names"), F.sort_array(F.collect_list(F.when(gone, F.struct((-F.col("collisions")).alias("c"), "name")))).alias("e"),
    )
    return each.select("source_id", "n_listed", "n_suppressed", "n_names", F.slice(F.transform("e", lambda x: x["name"]), 1, 3).alias("examples"))


def callers(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """``target_id, source_id, tier, confidence``: confident callers, and possible ones that are not
    confident. Possible callers of a name at or above the collision threshold are not listed."""
    sure = resolved.where(~F.col("ambiguous")).select("target_id", "source_id", "confidence", F.when(F.col("confidence") >= CONFIDENT, "confident").when(F.col("confidence") >= POSSIBLE, "possible").alias("tier"))
    few = split_ambiguous(resolved, symbols).where("NOT suppressed").select("source_id", "key", "confidence")
    maybe = few.join(class_keys(symbols).withColumnRenamed("id", "target_id"), "key").select("target_id", "source_id", "confidence", F.lit("possible").alias("tier"))
    rows = sure.unionByName(maybe).where("source_id != target_id AND tier IS NOT NULL")
    best = F.max(F.struct(F.when(F.col("tier") == "confident", 1).otherwise(0).alias("c"), "confidence"))
    return rows.groupBy("target_id", "source_id").agg(F.min("tier").alias("tier"), best.alias("m")).select("target_id", "source_id", "tier", F.col("m.confidence").alias("confidence"))


def impact(calls: DataFrame, targets: DataFrame, depth: int = 2) -> DataFrame:
    """``target_id, source_id, hop``: who calls a target, directly or over others, with the least hop.

    ``calls`` has ``target_id, source_id`` of confident callers, ``targets`` has ``target_id``. Each
    hop is one join of the frontier; what was reached before is left out by an anti-join, and the
    lineage is cut from the third hop on.
    """
    # Read by every hop, so it is written once.
    edges = checkpointed(calls.select(F.col("target_id").alias("callee"), F.col("source_id").alias("caller")).distinct())
    frontier = targets.select("target_id", F.col("target_id").alias("at")).distinct()
    reached = None
    for hop in range(1, max(1, depth) + 1):
        step = frontier.join(edges, F.col("at") == F.col("callee")).select("target_id", F.col("caller").alias("source_id")).where("source_id != target_id").distinct()
        if reached is not None:
            step = step.join(reached.select("target_id", "source_id"), ["target_id", "source_id"], "left_anti")
        if hop > 2:
            step = checkpointed(step)
        new = step.withColumn("hop", F.lit(hop))
        reached = new if reached is None else reached.unionByName(new)
        frontier = step.select("target_id", F.col("source_id").alias("at"))
    return reached


def delegation_leaves(resolved: DataFrame, symbols: DataFrame, max_lines: int = 15, most: int = 2, depth: int = 4) -> DataFrame:
    """``symbol_id, leaf_id``: what thin forwarders finally forward to, through other forwarders.

    A forwarder is a function or method of at most ``max_lines`` lines that calls one or two others.
    """
    # Read many times below, so it is written once.
    sure = checkpointed(resolved.where("NOT ambiguous AND source_id != target_id").select("source_id", "target_id").distinct())
    fan = sure.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most)
    thin = symbols.where(F.col("symbol_type").isin("function", "method") & ((F.col("end_line") - F.col("start_line") + 1).between(1, max_lines)))
    forwarders = fan.join(thin.select(F.col("id").alias("source_id")), "source_id").select("source_id")
    steps = sure.join(forwarders, "source_id", "left_semi").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    names = forwarders.select(F.col("source_id").alias("b"))
    open_ = steps.select(F.col("a").alias("symbol_id"), "b")
    leaves = open_.join(names, "b", "left_anti")
    for _ in range(depth - 1):
        open_ = open_.join(names, "b", "left_semi").join(steps.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("symbol_id", F.col("c").alias("b")).distinct()
        leaves = leaves.unionByName(open_.join(names, "b", "left_anti").select("b", "symbol_id"))
    return leaves.select("symbol_id", F.col("b").alias("leaf_id")).where("symbol_id != leaf_id").distinct()


def members(symbols: DataFrame) -> DataFrame:
    """``symbol_id, member_id``: symbols whose qualified name goes on from that of another symbol of the
    same repository, at any depth.

    The prefix join is an equi-join: a member is looked up under each beginning of its name.
    """
    s = normalized(symbols).select("id", "repo_id", "qname", F.split("qname", r"\.").alias("parts"))
    above = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda n: F.array_join(F.slice("parts", 1, n), "."))
    below = s.where(F.size("parts") > 1).select(F.col("id").alias("member_id"), "repo_id", F.explode(above).alias("qname"))
    return below.join(s.select(F.col("id").alias("symbol_id"), "repo_id", "qname"), ["repo_id", "qname"]).select("symbol_id", "member_id")


def impact_report(hops: DataFrame, possible: DataFrame, symbols: DataFrame, is_test) -> DataFrame:
    """``symbol_id, n_direct, n_direct_tests, n_indirect, n_possible, n_files, tested`` of every symbol:
    who is affected by a change of it. ``hops`` is the result of ``impact``, ``possible`` has
    ``target_id, source_id``, ``is_test`` says of a path whether it is a test's. The symbol's own file
    counts among the affected ones; a symbol is tested if a test calls it, directly or not."""
    place = symbols.select(F.col("id").alias("source_id"), F.col("path"), is_test(F.col("path")).alias("test"))
    known = hops.join(place, "source_id")
    own = symbols.select(F.col("id").alias("target_id"), "path", F.lit(0).alias("hop"), F.lit(False).alias("test"))
    each = known.select("target_id", "path", "hop", "test").unionByName(own)
    rolled = each.groupBy("target_id").agg(
        F.count_if(F.expr("hop = 1")).alias("n_direct"), F.count_if(F.expr("hop = 1 AND test")).alias("n_direct_tests"), F.count_if(F.expr("hop > 1")).alias("n_indirect"),
        F.countDistinct("path").alias("n_files"), F.max("test").alias("tested"),
    )
    maybe = possible.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_possible"))
    return rolled.join(maybe, "target_id", "left").select(F.col("target_id").alias("symbol_id"), "n_direct", "n_direct_tests", "n_indirect", F.coalesce("n_possible", F.lit(0)).alias("n_possible"), "n_files", "tested")


def graph_view(resolved: DataFrame, callers: DataFrame, symbols: DataFrame, imports: DataFrame, bases: DataFrame, most: int = 10) -> DataFrame:
    """What surrounds each symbol: ``symbol_id, callees, n_callees, n_ambiguous, callers, n_callers,
    n_possible, n_members, n_imports, bases``. Lists hold the first ``most`` refs in order, counts all.

    ``imports`` has ``file_id, target``, ``bases`` ``symbol_id, base``.
    """
    ref = F.concat("path", F.lit("::"), F.coalesce("qualified_name", "name"))
    refs = symbols.select("id", ref.alias("ref"))

    def first(df: DataFrame, key: str, name: str) -> DataFrame:
        """The count of each key and its first refs; only those are collected."""
        w = W.partitionBy(key).orderBy("ref")
        top = df.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).groupBy(key).agg(F.sort_array(F.collect_list("ref")).alias(name))
        return df.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{name}")).join(top, key).withColumnRenamed(key, "symbol_id")

    sure = resolved.where("NOT ambiguous AND source_id != target_id").select("source_id", "target_id").distinct()
    callees = first(sure.join(refs.withColumnRenamed("id", "target_id"), "target_id"), "source_id", "callees")
    certain = callers.where("tier = 'confident'").join(refs.withColumnRenamed("id", "source_id"), "source_id").select("target_id", "ref")
    called = first(certain, "target_id", "callers")
    vague = resolved.where("ambiguous").groupBy(F.col("source_id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("n_ambiguous"))
    maybe = callers.where("tier = 'possible'").groupBy(F.col("target_id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("n_possible"))
    below = members(symbols).groupBy("symbol_id").agg(F.count(F.lit(1)).alias("n_members"))
    imported = imports.groupBy("file_id").agg(F.countDistinct("target").alias("n_imports"))
    named = bases.groupBy("symbol_id").agg(F.sort_array(F.collect_set("base")).alias("bases"))
    out = symbols.select(F.col("id").alias("symbol_id"), "file_id")
    for part in (callees, called, vague, maybe, below, named):
        out = out.join(part, "symbol_id", "left")
    none = F.array().cast("array<string>")
    n = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return out.join(imported, "file_id", "left").select(
        "symbol_id", F.coalesce("callees", none).alias("callees"), n("n_callees"), n("n_ambiguous"), F.coalesce("callers", none).alias("callers"), n("n_callers"), n("n_possible"),
        n("n_members"), n("n_imports"), F.coalesce("bases", none).alias("bases"),
    )


def module_edges(resolved: DataFrame, symbols: DataFrame, module_of) -> DataFrame:
    """Confident calls between modules, counted."""
    place = symbols.select("id", module_of(F.col("path")).alias("module"))
    sure = resolved.where((~F.col("ambiguous")) & (F.col("confidence") >= CONFIDENT))
    joined = sure.join(place.select(F.col("id").alias("source_id"), F.col("module").alias("src")), "source_id").join(
        place.select(F.col("id").alias("target_id"), F.col("module").alias("dst")), "target_id"
    )
    return joined.where("src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_calls"))
