"""Ranking of nodes for texts: BM25 over token bags and some twenty signals, gates, totals and anchors, batched over queries.

nodes: node_id, path, name, kind, symbols, line_start, line_end, pr, calls, inherits, cluster, cluster_size; see with_defaults
for nodes of which only path and name are known. queries: query_id, text. Nodes of equal scores follow by path, then node_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..functions.lineage import few, product_tasks, written

BETAS = dict(lex=0.25, trace=5.0, sym=4.0, cent=0.3, idf=0.2, reg=0.0, stem=1.0, path_term=4.5, explicit_path=6.0, symbol_exact=35.0, dunder=12.0, domain=15.0, error_code=25.0, upper_const=18.0, mgmt_command=30.0, call_target=3.0, inherit_target=4.0, term_idf=2.5)
#: What stands for a weight that a configuration lacks.
FALLBACK = dict(lex=1.0, trace=2.5, sym=1.4, cent=1.2, idf=0.8, reg=0.9, stem=0.7, path_term=0.9, explicit_path=6.0, symbol_exact=5.0, dunder=8.0, domain=0.0, error_code=0.0, upper_const=0.0, mgmt_command=0.0, call_target=3.0, inherit_target=4.0, term_idf=2.5)
BETA_TEST, BETA_MIGRATION, TOPK, MARGIN, TEMPERATURE = 2.5, 3.0, 3, 0.08, 0.5
TEST_TERMS = sorted("testcase test_runner runtests pytest unittest conftest assertraises setup".split() + ["test suite", "test framework"])
MIGRATION_TERMS = sorted("schema_editor /migrations/ proxy_permissions update_proxy makemigrations 0001_ 0002_ 0003_".split())
GENERIC = sorted("Exception Error QuerySet Query Manager Meta View Form Model Field".split())
ORM = sorted("sql queries models. db.models schema_editor aggregate annotate prefetch_related select_related on_delete to_field migration makemigrations db_index db_table onetoone manytomany foreignkey primary_key meta.ordering models.model objects. queryset. queryset".split())
FORMS = sorted("help_text helptext formset boundfield errorlist html= render( <select <form <input request.post is_valid() cleaned_data render_value widget modelform forms.form".split() + ["form field"])
ADMIN = sorted("admin/ list_filter list_display modeladmin adminsite admin.".split() + ["admin panel"])
K1, B = 1.5, 0.75
#: Queries of whom a node has its scores in a map.
MAP_QUERIES = 1000


def with_defaults(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """nodes (node_id, path, name, line_start, line_end) with what is known of them (node_id, kind, symbols, pr, calls, inherits,
    cluster); the others have an inferred kind, no symbols, rank 0 and the folder of their lower-cased path as their cluster."""
    low = F.lower(F.translate("path", "\\", "/"))
    out = nodes.join(known, "node_id", "left").withColumns({
        "kind": F.coalesce("kind", paths.inferred_kind(F.col("path"))), "symbols": F.coalesce("symbols", F.array().cast("array<string>")), "pr": F.coalesce("pr", F.lit(0.0)),
        "calls": F.coalesce("calls", F.lit(0)), "inherits": F.coalesce("inherits", F.lit(0)), "cluster": F.coalesce("cluster", F.when(F.col("path").isNull(), "").otherwise(paths.cluster(low))),
    })
    return out.join(out.groupBy("cluster").agg(F.count("*").alias("cluster_size")), "cluster")


def bm25(docs: DataFrame, queries: DataFrame, tasks: int | None = None) -> DataFrame:
    """(query_id, doc_id, score) of docs (doc_id, terms) for queries (query_id, terms), where a term is shared. Repeated query terms count.

    A term of many queries and many documents makes a row for each pair, so documents are dealt to tasks (by the number of such
    rows, if not given) and meet all queries' terms there.

    Document frequencies and lengths cover all docs; only terms of queries are joined with their postings. Terms are written
    down once as counts, as the lengths and both frequencies come from them.
    """
    wanted = queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    wanted = written(wanted)
    keep = wanted.select("term").distinct()
    sized = docs.select("doc_id", F.size("terms").alias("dl"), "terms")
    counted = sized.select("doc_id", "dl", F.explode_outer("terms").alias("term"))
    # A row of no term for each document carries its length; the rest are the postings of wanted terms.
    postings = written(counted.join(few(keep.withColumn("hit", F.lit(True)), 1_000_000), "term", "left").groupBy("doc_id", "dl", F.when(F.col("hit"), F.col("term")).alias("term")).agg(F.count("*").alias("tf")))
    lengths = postings.select("doc_id", "dl").distinct()
    total = lengths.agg(F.count("*").alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avg"))  # one row
    hits = postings.filter("term is not null")
    n = hits.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighed = hits.join(n, "term").withColumn("w", F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg"))) * idf)
    if tasks is None:
        pairs = weighed.groupBy("term").agg(F.count("*").alias("d")).join(wanted.groupBy("term").agg(F.count("*").alias("q")), "term")
        tasks = product_tasks(docs.sparkSession, pairs.agg(F.sum(F.col("d") * F.col("q"))).first()[0] or 0, 1)
    weighed = weighed.select("doc_id", "term", "w").repartition(tasks, "doc_id")
    return weighed.join(few(wanted, 1_000_000), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("qtf")).alias("score"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ties to the lesser id."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
    return scores.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _sum(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + f(x))


def _count(words: list[str], low: Column) -> Column:
    return _sum(text.strings(words), lambda w: F.contains(low, w).cast("double"))


def with_terms(queries: DataFrame) -> DataFrame:
    """queries with what the signals read from their texts."""
    t = F.col("text")
    mined = queries.withColumns({"low": F.lower(t), "terms": text.code_terms(t), "frames": text.frames(t), "explicit": text.explicit_paths(t), "codes": text.error_codes(t), "consts": text.upper_constants(t), "verbs": text.verbs(t), "dunders": text.dunders(t), "tokens": text.tokens(t)})
    return mined.withColumns({"net": _count(ORM, F.col("low")) - _count(FORMS, F.col("low")), "admin": _count(ADMIN, F.col("low"))})


def _dealt(nodes: DataFrame, tasks: int | None) -> DataFrame:
    return nodes.repartition(*([tasks] if tasks else []), "node_id")


def _weight(symbol: Column) -> Column:
    return 1.0 + F.when(F.length(symbol) >= 8, 0.5).otherwise(0.0) + F.when(F.substr(symbol, F.lit(2)).rlike(r"\p{Lu}"), 0.5).otherwise(0.0)


def symbol_exact(nodes: DataFrame, queries: DataFrame, tasks: int | None = None) -> DataFrame:
    """(query_id, node_id, symbol_exact): terms that are symbols count by how telling they are, the parts of dotted terms at seven
    tenths; each name counts once, as it comes first. A join by name; nodes are dealt to so many tasks, since a name that many
    nodes and queries have makes a row for each pair."""
    terms = queries.select("query_id", F.posexplode("terms").alias("pos", "term")).select("query_id", "pos", F.lower("term").alias("term"))
    whole = terms.select("query_id", "pos", F.lit(0).alias("at"), F.col("term").alias("l"), "term")
    parts = terms.filter(F.contains("term", F.lit("."))).select("query_id", "pos", F.posexplode(F.split("term", r"\.")).alias("at", "l"), "term").filter("l <> ''")
    spelled = nodes.select("node_id", F.posexplode("symbols").alias("k", "s")).groupBy("node_id", F.lower("s").alias("l")).agg(F.max_by("s", "k").alias("s"))
    asked = written(whole.withColumn("part", F.lit(False)).unionByName(parts.withColumn("part", F.lit(True))))
    hits = _dealt(spelled, tasks).join(few(asked, 1_000_000), "l")
    # A dotted term that is a symbol as a whole has no parts.
    taken = F.max(~F.col("part") & F.contains("term", F.lit("."))).over(Window.partitionBy("query_id", "node_id", "pos"))
    hits = hits.withColumn("taken", taken).filter(~(F.col("part") & F.col("taken")))
    first = hits.groupBy("query_id", "node_id", "l").agg(F.min_by(F.struct("part", "s"), F.struct("pos", "at")).alias("m"))
    w = _weight(F.col("m.s")) * F.when(F.col("m.part"), 0.7).when(F.col("m.s").isin(GENERIC), 0.4).otherwise(1.0)
    return first.groupBy("query_id", "node_id").agg(F.sum(w).alias("symbol_exact"))


def term_idf(nodes: DataFrame, queries: DataFrame, n: int, tasks: int | None = None) -> DataFrame:
    """(query_id, node_id, term_idf): log(1 + n / nodes) of each distinct term that is a symbol or the stem of the node, whole or by its
    tail. Nodes are dealt to so many tasks."""
    terms = queries.select("query_id", F.explode(F.array_distinct(F.transform("terms", F.lower))).alias("term"))
    keys = terms.select("query_id", "term", F.explode(F.array_distinct(F.array("term", text.tail(F.col("term"))))).alias("key")).filter("key <> ''")
    names = nodes.select("node_id", F.explode(F.array_distinct(F.concat("lows", F.array("stem_")))).alias("key"))
    keys = written(keys)
    of_term = keys.select("term", "key").distinct()
    df = written(names.join(few(of_term, 1_000_000), "key").select("term", "node_id").distinct().groupBy("term").agg(F.count("*").alias("df")))
    hits = _dealt(names, tasks).join(few(keys.join(df, "term"), 1_000_000), "key").select("query_id", "term", "node_id", "df").distinct()
    return hits.groupBy("query_id", "node_id").agg(F.sum(F.log(1 + F.lit(float(n)) / F.col("df"))).alias("term_idf"))


def _domain(p: Column) -> Column:
    slashed = F.concat(F.lit("/"), p)
    bias = F.tanh(F.col("net") / 3.0)
    area = F.when(F.contains(slashed, F.lit("/db/models/")), 1.0).when(F.contains(slashed, F.lit("/db/")), 0.5).otherwise(0.0) - F.when(F.contains(slashed, F.lit("/forms/")), 1.0).otherwise(0.0)
    return area * bias + F.when(F.contains(slashed, F.lit("/contrib/admin/")) & (F.col("admin") >= 1), 0.5).otherwise(0.0)


def _error(p: Column) -> Column:
    def one(code: Column) -> Column:
        prefix = F.substring_index(code, ".", 1)
        has = lambda *x: F.contains(p, F.concat(*x))
        checks = has(F.lit("checks/"), prefix) | has(prefix, F.lit("_checks")) | F.endswith(p, F.concat(prefix, F.lit("/checks.py"))) | has(F.lit("/"), prefix, F.lit("/checks.py"))
        return (
            F.when(checks, 1.0)
            .when(has(F.lit("/checks/")) & has(prefix), 0.7)
            .when((prefix == "fields") & has(F.lit("db/models/fields/__init__")), 0.6)
            .when((prefix == "models") & has(F.lit("db/models/")) & has(F.lit("checks")), 0.8)
            .otherwise(0.0)
        )

    return _sum(F.col("codes"), one)


def token_bag(nodes: DataFrame) -> Column:
    return F.concat(text.tokens(F.translate("path", "/\\", "  ")), text.tokens(F.col("name")), text.tokens(F.array_join("symbols", " ")))


def signals(nodes: DataFrame, queries: DataFrame, cap: float) -> DataFrame:
    """(query_id, node_id, path, name, kind, cluster, a column for each of BETAS, into, low, ...) of all nodes for all queries.

    The product of nodes and queries is what is asked for: the result has a row for each pair. Nodes are dealt to tasks by the
    number of pairs, and the side of the queries is read into every task. BM25, exact symbols and term frequencies are found by
    keys in the same tasks, and each node takes its own along as a map by query, so pairs aren't shuffled; with too many queries
    for that they are joined. Null paths count as empty ones.
    """
    nodes = nodes.withColumn("path", F.coalesce("path", F.lit("")))
    nodes = nodes.withColumns({"lows": F.transform("symbols", F.lower), "lp": F.lower(F.translate("path", "\\", "/"))}).withColumns({"stem_": paths.stem(F.col("lp")), "base_": paths.base(F.col("lp"))})
    # Whatever a text or a node alone tells is told before they meet.
    low_path = lambda f: F.lower(f["path"])
    lows = F.transform("terms", F.lower)
    told = with_terms(queries).withColumns({
        "frames_": F.transform("frames", lambda f: F.struct(low_path(f).alias("path"), paths.base(low_path(f)).alias("base"), f["line"].alias("line"))),
        "lows_": F.transform(lows, lambda t: F.struct(t.alias("t"), text.tail(t).alias("tail"))),
        "py_": F.transform(F.filter(lows, lambda t: F.endswith(t, F.lit(".py"))), lambda t: F.struct(t.alias("t"), paths.base(t).alias("base"))),
    })
    q = written(told)
    n = nodes.count()
    tasks = product_tasks(nodes.sparkSession, n, q.count())
    lex = bm25(nodes.select(F.col("node_id").alias("doc_id"), token_bag(nodes).alias("terms")), q.select("query_id", F.col("tokens").alias("terms")), tasks).select("query_id", F.col("doc_id").alias("node_id"), F.col("score").alias("lex"))
    keyed = {"lex": lex, "symbol_exact": symbol_exact(nodes, q, tasks), "term_idf": term_idf(nodes, q, n, tasks)}
    p, low = F.col("lp"), F.col("low")
    filed = p != ""
    hit = lambda f: filed & (F.endswith(p, f["path"]) | F.endswith(f["path"], p))
    same = lambda f: filed & (F.col("base_") == f["base"])
    sym = F.coalesce(F.array_max(F.flatten(F.transform("lows_", lambda t: F.transform("lows", lambda s: F.when(s == t["t"], 1.0).when(s == t["tail"], 0.85).when(F.contains(s, t["t"]) | F.contains(t["t"], s), 0.5).otherwise(0.0))))), F.lit(0.0))
    explicit = F.transform("explicit", lambda e: F.when(F.endswith(p, e), 1.0).when(~F.endswith(e, F.lit(".py")) & F.contains(F.concat(F.lit("/"), p, F.lit("/")), F.concat(F.lit("/"), e, F.lit("/"))), 0.5).otherwise(0.0))
    settings = F.contains(p, F.lit("conf/global_settings")) | F.endswith(p, F.lit("conf/__init__.py")) | F.contains(p, F.lit("/conf/__init__"))
    made = {
        "trace": _sum(F.col("frames_"), lambda f: F.when(hit(f), 1.0 + F.when(f["line"].between(F.col("line_start"), F.col("line_end")), 1.5).otherwise(0.0)).when(same(f), 0.5).otherwise(0.0)),
        "sym": sym,
        "cent": F.log1p(F.least("pr", F.lit(cap)) * 1000),
        "idf": F.log(1 + 1 / F.greatest(F.lit(1), "cluster_size")),
        "reg": (F.col("kind") == "registry").cast("double"),
        "stem": F.when((F.length("stem_") > 3) & (F.col("stem_") != "__init__") & F.contains(low, F.col("stem_")), 1.0).otherwise(0.0),
        "path_term": F.when(F.exists("py_", lambda t: F.endswith(p, t["t"]) | (F.col("base_") == t["base"])), 1.0).otherwise(0.0),
        "explicit_path": F.coalesce(F.get(F.filter(explicit, lambda v: v > 0), F.lit(0)), F.lit(0.0)),
        "dunder": F.when(F.size("dunders") > 0, F.contains(p, F.lit("lookups")).cast("double") + _sum(F.col("dunders"), lambda d: F.array_contains(F.col("lows"), d).cast("double") + F.array_contains(F.col("lows"), F.replace(d, F.lit("_"), F.lit(""))).cast("double"))).otherwise(0.0),
        "domain": _domain(p),
        "error_code": _error(p),
        "upper_const": F.when(F.size("consts") == 0, 0.0).when(settings, F.least(F.size("consts"), F.lit(3)).cast("double")).when(F.contains(p, F.lit("settings")), 0.5).otherwise(0.0),
        "mgmt_command": _sum(F.col("verbs"), lambda v: F.when(F.endswith(p, F.concat(F.lit("management/commands/"), v, F.lit(".py"))) | F.contains(p, F.concat(F.lit("/management/commands/"), v, F.lit(".py"))), 1.0).when(v.isin("sqlmigrate", "migrate", "makemigrations", "showmigrations") & p.rlike("db/migrations/(executor|loader)[.]py$"), 0.4).otherwise(0.0)),
        "call_target": F.least(F.lit(1.0), 0.2 * F.col("calls")),
        "inherit_target": F.least(F.lit(1.0), 0.25 * F.col("inherits")),
        "into": F.exists("frames_", lambda f: hit(f) | same(f)),
    }
    if by_node := q.limit(MAP_QUERIES + 1).count() <= MAP_QUERIES:
        nodes = nodes.repartition(tasks, "node_id")
        for name, found in keyed.items():
            own = found.filter("query_id is not null").groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("query_id", name))).alias(f"__{name}"))
            nodes = nodes.join(own.hint("merge"), "node_id", "left")
            made[name] = F.coalesce(F.try_element_at(F.col(f"__{name}"), F.col("query_id")), F.lit(0.0))
    pairs = (nodes if by_node else nodes.repartition(tasks)).crossJoin(few(q, 10_000)).withColumns(made)
    if not by_node:
        for found in keyed.values():
            pairs = pairs.join(found, ["query_id", "node_id"], "left")
        pairs = pairs.fillna(0.0, list(keyed))
    return pairs.select("query_id", "node_id", "path", "name", "kind", "cluster", "cluster_size", "pr", "calls", "inherits", "line_start", "line_end", *BETAS, "into", "low")


def gates() -> tuple[Column, Column]:
    """Whether the gates of tests and of numbered migrations hold a node back."""
    slashed, low = F.translate("path", "\\", "/"), F.col("low")
    p = F.lower(slashed)
    admits = lambda terms: F.exists(text.strings(terms), lambda t: F.contains(low, t))
    test = (F.col("kind") == "test") | F.contains(F.concat(F.lit("/"), p), F.lit("/tests/")) | paths.base(p).startswith("test_")
    numbered = p.rlike(r"/migrations/[0-9]{4}_[a-z][a-z0-9_]+[.]py$") | ((F.col("kind") == "migration") & paths.base(p).rlike("^[0-9]{4}_[a-z]"))
    named = low.rlike(rf"(?<!{text.WORD})[0-9]{{4}}_[a-z][a-z0-9_]+[.]py(?!{text.WORD})")
    return test & ~F.col("into") & ~admits(TEST_TERMS), numbered & ~F.col("into") & ~named & ~admits(MIGRATION_TERMS)


def scored(found: DataFrame, cap: float, betas: dict[str, float] | None = None) -> DataFrame:
    """found with the weighted sum of its signals, held back by the gates and lowered for hubs without evidence.

    betas: weights, BETAS if none; FALLBACK has those that it lacks.
    """
    betas, total = FALLBACK | (BETAS if betas is None else betas), F.lit(0.0)
    for name in BETAS:
        total = total + F.lit(betas[name]) * F.col(name)
    test, migration = gates()
    out = found.withColumns({"test_gate": test, "migration_gate": migration}).withColumn("score", total)
    out = out.withColumn("score", F.when(F.col("test_gate"), F.col("score") * 0.25 - BETA_TEST).otherwise(F.col("score")))
    out = out.withColumn("score", F.when(F.col("migration_gate"), F.col("score") * 0.15 - BETA_MIGRATION).otherwise(F.col("score")))
    hub = (F.col("pr") > 0.8 * cap) & (F.col("symbol_exact") + F.col("explicit_path") + F.col("trace") + F.col("error_code") == 0)
    return out.withColumn("score", F.when(hub, F.col("score") * 0.85).otherwise(F.col("score")))


def reasons(cap: float) -> Column:
    """array<string>: what spoke for or against a scored node, in a fixed order; values to the decimals shown."""
    c = F.col
    say = lambda test, label: F.when(test, label)
    shown = lambda form, value: F.format_string(form, F.bround(value, int(form[-2])))
    figure = lambda label, name, form: say(c(name) > 0, shown(f"{label}={form}", c(name)))
    items = [
        figure("explicit-path", "explicit_path", "%.1f"), figure("symbol-exact", "symbol_exact", "%.1f"), figure("dunder", "dunder", "%.1f"), say(c("domain") != 0, shown("domain=%+.2f", c("domain"))),
        figure("error-code", "error_code", "%.1f"), figure("upper-const", "upper_const", "%.1f"), figure("mgmt-cmd", "mgmt_command", "%.1f"),
        say(c("trace") > 0, F.lit("trace-overlap")), say(c("sym") >= 0.85, F.lit("symbol-match")), say(c("lex") > 0, F.lit("bm25-lex")), say(c("reg") > 0, F.lit("registry-prior")),
        say(c("cent") > 0, shown("pagerank=%.4f", F.least(c("pr"), F.lit(cap)))), say(c("idf") > 0, F.concat(F.lit("cluster-idf(size="), F.greatest(F.lit(1), "cluster_size").cast("string"), F.lit(")"))),
        *[say(c(k) > 0, F.concat(F.lit(f"{label}("), c(k).cast("string"), F.lit(")"))) for k, label in (("calls", "call-target"), ("inherits", "inherit-target"))],
        figure("term-idf", "term_idf", "%.2f"), say(c("test_gate"), F.lit("test-penalty")), say(c("migration_gate"), F.lit("migration-penalty")), say(c("stem") > 0, F.lit("stem-in-text")), say(c("path_term") > 0, F.lit("path-term")),
    ]
    return F.array_compact(F.array(*items))


def anchors(ranked: DataFrame, topk: int = TOPK, temperature: float = TEMPERATURE, margin: float = MARGIN) -> DataFrame:
    """(query_id, node_id, place, p, confidence, low_margin): the first node, by its share of the softmax over the best 2 topk; where
    the second is within the margin of it, also those of the topk that are within one and a half margins."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "path", "node_id")
    own = Window.partitionBy("query_id")
    best = ranked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= 2 * topk)
    e = F.exp((F.col("score") - F.max("score").over(own)) / temperature)
    p = best.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(own))
    first = F.max(F.when(F.col("place") == 1, F.col("p"))).over(own)
    second = F.coalesce(F.max(F.when(F.col("place") == 2, F.col("p"))).over(own), F.lit(0.0))
    told = p.withColumns({"confidence": F.round(first, 3), "low_margin": first - second < margin, "__first": first})
    tied = F.col("low_margin") & (F.col("place") <= topk) & (F.col("p") >= F.col("__first") - 1.5 * margin)
    return told.filter((F.col("place") == 1) | tied).select("query_id", "node_id", "place", "p", "confidence", "low_margin")
