"""The dependency graph: building, centrality, cycles.

nodes: id, type, name, metadata; edges: src, dst, type, metadata, no parallel
edges. Ids are ``module:<path>`` and ``table:<name>``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe import vocab
from auditframe.functions.paths import detect_language, extension
from auditframe.operators.common import count_where, one_row
from auditframe.operators.cycles import cycle_search, least_labels
from auditframe.operators.scope import is_scoped, node_of, resolved, table_ids
from auditframe.session import materialize, materialize_counted, scratch_path


#: Parameters of betweenness: rows of (source, reached node) that one portion of sources may have, and rounds of folding leaves.
MAX_STATE = 20_000_000
FOLD_ROUNDS = 32


def _text_map(**values: Column) -> Column:
    return F.create_map(*[part for k, v in values.items() for part in (F.lit(k), v.cast("string"))])


def module_nodes(files: DataFrame) -> DataFrame:
    """A node per source file in a supported language."""
    known = files.where(extension(F.col("path")).isin(*vocab.GRAPH_LANGUAGES))
    return known.select(
        F.concat(F.lit("module:"), "path").alias("id"),
        F.lit("module").alias("type"),
        F.col("path").alias("name"),
        _text_map(language=detect_language(F.col("path"), vocab.GRAPH_LANGUAGES, "Unknown")).alias("metadata"),
    )


def table_nodes(tables: DataFrame) -> DataFrame:
    """A node per table of the schema; where tables name dump and database, per table of each dump that shares its name."""
    if is_scoped(tables):
        ids = table_ids(tables).select("id", *[F.col(c).alias(f"_{c}") for c in ("dump", "database", "table")])
        same = (F.col("table") == F.col("_table")) & F.col("dump").eqNullSafe(F.col("_dump")) & F.col("database").eqNullSafe(F.col("_database"))
        named = tables.join(ids, same)
        place = {"database": F.when(F.col("id") != node_of(F.col("table")), F.col("database"))}
    else:
        named, place = tables.select(node_of(F.col("table")).alias("id"), "table", "n_columns", "n_indexes"), {}
    return named.select(
        "id",
        F.lit("table").alias("type"),
        F.col("table").alias("name"),
        F.map_filter(_text_map(columns=F.col("n_columns"), indexes=F.col("n_indexes"), **place), lambda k, v: (k != "database") | v.isNotNull()).alias("metadata"),
    ).dropDuplicates(["id"])


def code_db_edges(code_sql: DataFrame, nodes: DataFrame) -> DataFrame:
    """``uses`` edges from modules to the tables their SQL names.

    Both nodes must exist; the last occurrence in a file describes the edge.
    Names meet by lower case on both sides. Code does not say which database it means, so a name that several
    databases share leads to the node of the name itself, ``table:<name>`` in lower case.
    """
    tables = nodes.where(F.col("type") == "table").select("id", F.lower("name").alias("key"))
    plain = F.lower("id") == node_of(F.col("key"))
    tables = tables.where(plain).select(F.col("id").alias("dst"), "key").unionByName(
        tables.where(~plain).select(node_of(F.col("key")).alias("dst"), "key").distinct())
    modules = nodes.where(F.col("type") == "module").select(F.col("id").alias("src"))
    used = code_sql.where(
        F.col("table").isNotNull() & extension(F.col("path")).isin(*vocab.DATABASE_USER_EXTENSIONS)
    ).select(
        F.concat(F.lit("module:"), "path").alias("src"), F.lower("table").alias("key"), "line", "type"
    )
    last = used.groupBy("src", "key").agg(F.max(F.struct("line", "type")).alias("last"))
    return (
        last.join(tables, "key")
        .join(modules, "src", "left_semi")
        .select(
            "src",
            "dst",
            F.lit("uses").alias("type"),
            _text_map(query_type=F.coalesce("last.type", F.lit("unknown")), line=F.col("last.line")).alias("metadata"),
        )
    )


def import_edges(code_imports: DataFrame, modules: DataFrame, match: str = "exact") -> DataFrame:
    """``imports`` edges between Python modules.

    ``match="exact"`` needs the imported name to be the module's full dotted
    path, ``match="suffix"`` also accepts its last part where only one module has
    it, so an import never fans out to all modules of a common name.
    """
    dotted = F.replace(F.regexp_replace("name", r"\.py$", ""), F.lit("/"), F.lit("."))
    targets = modules.where(F.endswith("name", F.lit(".py"))).select(F.col("id").alias("dst"), dotted.alias("module"))
    if match == "suffix":
        last = targets.groupBy(F.substring_index("module", ".", -1).alias("module")).agg(
            F.min("dst").alias("dst"), F.count("*").alias("modules")
        )
        targets = targets.unionByName(last.where(F.col("modules") == 1).select("dst", "module")).distinct()
    elif match != "exact":
        raise ValueError(f"unknown match: {match}")
    imported = (
        code_imports.where(extension(F.col("path")) == ".py")
        .select(F.concat(F.lit("module:"), "path").alias("src"), "module")
        .distinct()
    )
    edges = imported.join(targets, "module")
    if match == "suffix":
        edges = edges.groupBy("src", "dst").agg(F.max("module").alias("module"))
    return edges.select("src", "dst", F.lit("imports").alias("type"), _text_map(**{"import": F.col("module")}).alias("metadata"))


def fk_edges(columns: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """``references`` edges from foreign keys; the last column of a pair describes it.

    With ``tables`` that name dump and database, as the columns then must, a name means the table of its own dump first.
    """
    keys = columns.where(F.col("fk_table").isNotNull() & (F.col("fk_table") != ""))
    if tables is not None and is_scoped(tables) and is_scoped(columns):
        ids = table_ids(tables)
        pairs = keys.groupBy("dump", "database", "table", "fk_table").agg(F.max_by("column", "seq").alias("column"))
        pairs = resolved(resolved(pairs, ids, "table", "src"), ids, "fk_table", "dst")
        pairs = pairs.groupBy("src", "dst").agg(F.max_by("column", F.struct("dump", "table", "fk_table")).alias("column"))
    else:
        pairs = keys.groupBy(node_of(F.col("table")).alias("src"), node_of(F.col("fk_table")).alias("dst")).agg(F.max_by("column", "seq").alias("column"))
    return pairs.select("src", "dst", F.lit("references").alias("type"), _text_map(column=F.col("column")).alias("metadata"))


def edge_ends(edges: DataFrame) -> DataFrame:
    """The distinct nodes that edges mention: id."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def implicit_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that only edges mention, of type ``unknown``."""
    return edge_ends(edges).join(nodes.select("id"), "id", "left_anti").select(
        "id", F.lit("unknown").alias("type"), F.col("id").alias("name"), _text_map().cast("map<string,string>").alias("metadata")
    )


def build_graph(
    files: DataFrame,
    tables: DataFrame,
    columns: DataFrame,
    code_sql: DataFrame,
    code_imports: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the whole system.

    The three edge kinds link different kinds of ids, so their union has no
    parallel edges and needs no further de-duplication. Tables and columns that name dump and database are told apart by them.
    """
    modules = module_nodes(files)
    known = modules.unionByName(table_nodes(tables))
    to_tables = fk_edges(columns, tables).unionByName(code_db_edges(code_sql, known))
    return known.unionByName(implicit_nodes(to_tables, known)), to_tables.unionByName(import_edges(code_imports, modules))


def node_degrees(edges: DataFrame) -> DataFrame:
    """In-, out- and total degree per node that has an edge: id, in_degree, out_degree, degree.

    Both ends of an edge come from one read of it, and a hub's ends are summed
    in each task before the shuffle.
    """
    ends = edges.select(F.posexplode(F.array("src", "dst")).alias("is_dst", "id"))
    return (
        ends.groupBy("id")
        .agg(F.sum("is_dst").alias("in_degree"), F.count("*").alias("degree"))
        .select("id", "in_degree", (F.col("degree") - F.col("in_degree")).alias("out_degree"), "degree")
    )


def graph_metrics(nodes: DataFrame, edges: DataFrame, centrality: DataFrame | None = None) -> DataFrame:
    """Node and edge count, density, largest degree and betweenness centrality."""
    parts = [
        nodes.agg(F.count("*").alias("node_count")),
        edges.agg(F.count("*").alias("edge_count")),
        node_degrees(edges).agg(F.max("degree").alias("_degree")),
    ]
    if centrality is not None:
        parts.append(centrality.agg(F.max("betweenness_centrality").alias("max_betweenness_centrality")))
    n, m = F.col("node_count").cast("double"), F.col("edge_count")
    largest = (
        F.when(n > 1, F.coalesce("_degree", F.lit(0)) / (n - 1)).when(n == 1, F.lit(1.0)).otherwise(F.lit(0.0))
    )
    row = one_row(*parts)
    return row.select(
        "node_count",
        "edge_count",
        F.when((n <= 1) | (m == 0), F.lit(0.0)).otherwise(m / (n * (n - 1))).alias("density"),
        largest.alias("max_degree_centrality"),
        *(["max_betweenness_centrality"] if centrality is not None else []),
    )


def topology_statistics(nodes: DataFrame, edges: DataFrame, spofs: DataFrame) -> DataFrame:
    """Nodes, edges, modules, schema tables and single points of failure, as one row."""
    return one_row(
        nodes.agg(
            F.count("*").alias("total_nodes"),
            count_where(F.col("type") == "module").alias("modules"),
            count_where(F.col("type") == "table").alias("tables"),
        ),
        edges.agg(F.count("*").alias("total_edges")),
        spofs.agg(F.count("*").alias("spof_count")),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def betweenness(
    edges: DataFrame, nodes: DataFrame | None = None, source_batches: int | None = None, max_state: int = MAX_STATE, fold_rounds: int = FOLD_ROUNDS
) -> DataFrame:
    """Betweenness centrality of every node: id, betweenness_centrality.

    **Pendant trees** are folded first. A node with one neighbour is between others only where its own branches meet,
    which counts alone decide: how many nodes of a branch reach the node, and how many the node reaches there.
    Leaves are folded into their neighbours round by round, with these two counts as weights; ``fold_rounds``
    ends that early, which costs time but changes no result.

    **The core** that is left is searched from all its nodes, a join a distance; dependencies flow back along the edges that
    shortest paths took. Nodes stand for what was folded into them, as sources and as targets; sources that nothing points at and
    that point at the same nodes count as one. The state has a row per (source, reached node), in one written table per portion of
    sources. Sources are split into as many portions as ``max_state`` rows need, counted as sources times nodes of each
    weakly connected part; ``source_batches`` sets the number instead. Losing executors costs the current step only.
    """
    ends = edge_ends(edges)
    ids, n = materialize_counted(ends if nodes is None else nodes.select("id").unionByName(ends).distinct(), "nodes")
    links = materialize(edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct(), "edges")
    pairs, weights, folds = _folded_trees(links, fold_rounds)
    whole = materialize(_core_flows(pairs, weights, source_batches, max_state), "core")

    # What reaches a node and what it reaches in all: known in the core, then leaf by leaf from the last round back.
    totals = [materialize(whole.select("v", "inw", "outw", (F.col("inw") + F.col("rin")).alias("all_in"), (F.col("outw") + F.col("rout")).alias("all_out"), "delta"), "totals")]
    for leaves in reversed(folds):
        above = _union(totals)
        own = leaves.withColumnRenamed("x", "v").join(above.select(F.col("v").alias("y"), "all_in", "all_out"), "y")
        totals.append(materialize(own.select(
            "v", "inw", "outw",
            (F.col("inw") + F.when(F.col("down"), F.col("all_in") - F.when(F.col("up"), F.col("inw")).otherwise(0)).otherwise(0)).alias("all_in"),
            (F.col("outw") + F.when(F.col("up"), F.col("all_out") - F.when(F.col("down"), F.col("outw")).otherwise(0)).otherwise(0)).alias("all_out"),
            F.lit(0.0).alias("delta")), "totals"))
    meeting = [
        leaves.where("up and down").select(F.col("y").alias("v"), (F.col("inw").cast("double") * F.col("outw")).alias("same")) for leaves in folds]
    both = _union(totals)
    if meeting:
        both = both.join(_union(meeting).groupBy("v").agg(F.sum("same").alias("same")), "v", "left")
    else:
        both = both.withColumn("same", F.lit(0.0))
    rest_in, rest_out = F.col("all_in") - F.col("inw"), F.col("all_out") - F.col("outw")
    # Pairs in different branches, the rest of the graph being one; pairs within the rest are the core's.
    across = (F.col("all_in") - 1).cast("double") * (F.col("all_out") - 1) - F.coalesce("same", F.lit(0.0)) - rest_in.cast("double") * rest_out
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    scores = both.select(F.col("v").alias("id"), (across + F.col("delta")).alias("score"))
    return ids.join(scores, "id", "left").select("id", (F.coalesce("score", F.lit(0.0)) * scale).alias("betweenness_centrality"))


def _folded_trees(links: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Links of the core; nodes with weights (v, inw, outw) that are not folded; and the leaves of each round.

    Leaves: x, its neighbour y, whether x points at y (up) and y at x (down), and the weights of x: how many nodes of its
    tree reach it and how many it reaches there, itself included.
    """
    sides = F.explode(F.array(
        F.struct(F.col("src").alias("v"), F.col("dst").alias("w"), F.lit(True).alias("up"), F.lit(False).alias("down")),
        F.struct(F.col("dst").alias("v"), F.col("src").alias("w"), F.lit(False).alias("up"), F.lit(True).alias("down"))))
    pairs = materialize(links.select(sides.alias("e")).select("e.*").groupBy("v", "w").agg(F.max("up").alias("up"), F.max("down").alias("down")), "pairs")
    one = F.lit(1).cast("bigint")
    weights = materialize(pairs.select("v").distinct().select("v", one.alias("inw"), one.alias("outw")), "weights")
    folds: list[DataFrame] = []
    while len(folds) < rounds:
        alone = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("y"), F.max("up").alias("up"), F.max("down").alias("down")).where("n = 1")
        # Of two that have only each other, the smaller stays.
        twins = alone.select(F.col("v").alias("y"), F.col("y").alias("v"), F.lit(True).alias("twin"))
        alone = alone.join(twins, ["v", "y"], "left").where(F.col("twin").isNull() | (F.col("v") > F.col("y")))
        leaves, found = materialize_counted(alone.join(weights, "v").select(F.col("v").alias("x"), "y", "up", "down", "inw", "outw"), "leaves")
        if not found:
            break
        folds.append(leaves)
        gained = leaves.groupBy(F.col("y").alias("v")).agg(
            F.sum(F.when(F.col("up"), F.col("inw")).otherwise(0)).alias("more_in"), F.sum(F.when(F.col("down"), F.col("outw")).otherwise(0)).alias("more_out"))
        gone = leaves.select(F.col("x").alias("v"))
        weights = materialize(weights.join(gone, "v", "left_anti").join(gained, "v", "left").select(
            "v", (F.col("inw") + F.coalesce("more_in", F.lit(0))).alias("inw"), (F.col("outw") + F.coalesce("more_out", F.lit(0))).alias("outw")), "weights")
        pairs = materialize(pairs.join(gone, "v", "left_anti").join(gone.withColumnRenamed("v", "w"), "w", "left_anti").select("v", "w", "up", "down"), "pairs")
    return pairs.where("up").select(F.col("v").alias("src"), F.col("w").alias("dst")), weights, folds


def _core_flows(links: DataFrame, weights: DataFrame, source_batches: int | None, max_state: int) -> DataFrame:
    """Per node that is not folded: v, inw, outw, rin and rout (what reaches it and what it reaches elsewhere) and delta, its share of paths inside the core."""
    links, size = materialize_counted(links.join(weights.select(F.col("v").alias("dst"), "outw"), "dst").select("src", "dst", "outw"), "core-edges")
    if not size:
        return weights.select("*", *[F.lit(0).cast("bigint").alias(c) for c in ("rin", "rout")], F.lit(0.0).alias("delta"))
    members = materialize(_folded_sources(links, weights), "sources")
    sources, n_sources = materialize_counted(members.groupBy("s").agg(F.sum("inw").alias("weight")), "sources")
    if source_batches is None:
        source_batches = _portions(links, sources, max_state)
    parts = []
    for batch in range(source_batches):
        chosen = sources.where(F.pmod(F.hash("s"), F.lit(source_batches)) == batch) if source_batches > 1 else sources
        visited, flows = _dependencies(links, chosen.select("s"))
        pairs = visited.join(chosen, "s").join(weights.select("v", "outw"), "v").where(F.col("s") != F.col("v"))
        reached = pairs.groupBy("v").agg(F.sum("weight").alias("rin")).select("v", "rin", _zero("rout"), F.lit(0.0).alias("delta"))
        reaching = pairs.groupBy("s").agg(F.sum("outw").alias("rout")).join(members.select("s", "v"), "s").select("v", _zero("rin"), "rout", F.lit(0.0).alias("delta"))
        found = [reached, reaching]
        if flows:
            found.append(_union(flows).join(chosen, "s").where(F.col("s") != F.col("v")).groupBy("v").agg(F.sum(F.col("delta") * F.col("weight")).alias("delta"))
                         .select("v", _zero("rin"), _zero("rout"), "delta"))
        parts.append(materialize(_union(found), "dependencies"))
    total = _union(parts).groupBy("v").agg(F.sum("rin").alias("rin"), F.sum("rout").alias("rout"), F.sum("delta").alias("delta"))
    return weights.join(total, "v", "left").select(
        "v", "inw", "outw", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("rin", "rout")], F.coalesce("delta", F.lit(0.0)).alias("delta"))


def _zero(name: str) -> Column:
    return F.lit(0).cast("bigint").alias(name)


def _portions(links: DataFrame, sources: DataFrame, max_state: int) -> int:
    """Portions of sources whose state is expected within ``max_state`` rows: a source reaches no more than its weakly connected part."""
    both = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    parts = least_labels(both).select("node", "f")
    sizes = parts.join(sources.select(F.col("s").alias("node"), F.lit(1).alias("is_source")), "node", "left").groupBy("f").agg(
        F.count(F.lit(1)).alias("nodes"), F.count("is_source").alias("sources"))
    work = sizes.agg(F.sum(F.col("nodes").cast("double") * F.col("sources"))).first()[0] or 0.0
    return max(1, -int(-work // max_state))


def _folded_sources(links: DataFrame, weights: DataFrame) -> DataFrame:
    """The nodes of the core and the source that each is searched as: s, v, inw.

    Paths out of a node without predecessors depend on its successors alone. Sets of
    successors are compared by their size and two sums of 64-bit hashes.
    """
    reached = links.select(F.col("dst").alias("src")).distinct().withColumn("inner", F.lit(True))
    wide = "decimal(38,0)"
    out = links.groupBy("src").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("dst").cast(wide)).alias("one"),
        F.sum(F.xxhash64(F.concat("dst", F.lit("/"))).cast(wide)).alias("two"),
    ).join(reached, "src", "left")
    keys = ["n", "one", "two", "alone"]
    out = out.select("src", "n", "one", "two", F.coalesce(F.when(F.col("inner"), F.col("src")), F.lit("")).alias("alone"))
    least = out.groupBy(*keys).agg(F.min("src").alias("s"))
    return out.join(least, keys).select("s", F.col("src").alias("v")).join(weights.select("v", "inw"), "v")


def _dependencies(links: DataFrame, sources: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The visited pairs (s, v, sigma), and per distance how much each source depends on each node it passes: s, v, delta.

    Levels are parts of one written table, which tells what was visited. The way out keeps the edges that shortest
    paths take, per source. The way back follows only those, so a node with many predecessors costs no more than
    the paths that really reach it.
    """
    spark = links.sparkSession
    root = scratch_path(spark, "visited")
    first = sources.select("s", F.col("s").alias("v"), F.lit(1.0).alias("sigma"))

    def written(rows: DataFrame, level: int) -> DataFrame:
        rows.write.parquet(f"{root}/level={level}")
        return spark.read.schema(first.schema).parquet(f"{root}/level={level}")

    def visited() -> DataFrame:
        return spark.read.schema(first.schema).parquet(root).select("s", "v", "sigma")

    levels = [written(first, 0)]
    taken: list[DataFrame] = []
    while True:
        step = levels[-1].join(links, F.col("v") == F.col("src")).select("s", F.col("v").alias("u"), F.col("dst").alias("v"), "outw", "sigma")
        new, rows = materialize_counted(step.join(visited().select("s", "v"), ["s", "v"], "left_anti"), "taken")
        if rows == 0:
            break
        taken.append(new)
        levels.append(written(new.groupBy("s", "v").agg(F.sum("sigma").alias("sigma")), len(levels)))

    done: list[DataFrame] = []
    while len(taken) > 1:
        edges, reached = taken.pop(), levels.pop().withColumnRenamed("sigma", "sigma_v")
        if done:
            reached = reached.join(done[-1], ["s", "v"], "left")
        else:
            reached = reached.withColumn("delta", F.lit(0.0))
        share = F.col("sigma") * (F.col("outw") + F.coalesce("delta", F.lit(0.0))) / F.col("sigma_v")
        back = (
            edges.join(reached, ["s", "v"]).groupBy("s", F.col("u").alias("v")).agg(F.sum(share).alias("delta"))
        )
        done.append(materialize(back, "delta"))
    return visited(), [d.select("s", "v", "delta") for d in done]


def spofs(centrality: DataFrame, nodes: DataFrame, edges: DataFrame, threshold: float = vocab.SPOF_THRESHOLD) -> DataFrame:
    """Nodes whose betweenness exceeds ``threshold``, with degrees and risk level."""
    found = centrality.where(F.col("betweenness_centrality") > threshold)
    return (
        found.join(nodes.select("id", "type", "name"), "id", "left")
        .join(node_degrees(edges), "id", "left")
        .select(
            F.col("id").alias("node_id"),
            F.col("type").alias("node_type"),
            F.col("name").alias("node_name"),
            "betweenness_centrality",
            F.coalesce("degree", F.lit(0)).cast("bigint").alias("dependencies_count"),
            F.coalesce("in_degree", F.lit(0)).cast("bigint").alias("dependent_count"),
            F.when(F.col("betweenness_centrality") > vocab.SPOF_HIGH_THRESHOLD, "high")
            .otherwise("medium")
            .alias("risk_level"),
        )
    )


def ranked_spofs(found: DataFrame) -> DataFrame:
    """Single points of failure by falling centrality."""
    return found.orderBy(F.desc("betweenness_centrality"), "node_id")


def simple_cycles(edges: DataFrame, max_len: int | None = None) -> DataFrame:
    """All elementary circuits of at least two nodes, of ``max_len`` nodes at most: length, path.

    A circuit starts at its smallest node. Their number can be exponential; ``cycles.cycle_search`` can give up
    on single components and reports which are complete.
    """
    return cycle_search(edges, max_len)[0].select("length", "path")
