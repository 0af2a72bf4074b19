"""Phylogenetic trees as node tables.

A tree text is one row (dataset_id, tree_id, format, content); trees, tips, links and counts of
different datasets never mix. A node is named by the position of its opening token; an inner node spans
the tokens from ``open`` to ``close``, a tip has ``open = close``. Sums over clades are differences of
running sums, so no operator walks the tree.

All operators read the same lexemes: quoted pieces, comments, marks, runs of blanks and plain words.
Marks, blanks and commas inside quotes are text, a doubled quote stands for one, and blanks outside
quotes are dropped from labels. No pattern repeats a group, so a label may be of any length.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.intervals import cover, in_blocks, points_in_intervals
from ..plans.scans import running_sum
from ..plans.scratch import materialize
from ..plans.topk import first_per_key, joined_ranked, top_k

TREE = ["dataset_id", "tree_id"]
LEXEMES = "|".join([r"'[^']*+'", r'"[^"]*+"', r"\[[^\]]*+\]", r"[(),:;=]", r"\s++", r"[^\s(),:;='\"\[\]]++", r"['\"\[\]]"])
QUOTED, COMMENT, BLANK = r"^(?s:'.*'|\".*\")$", r"^(?s:\[.*\])$", r"^\s"


def _is_nexus(fmt: Column) -> Column:
    return F.lower(fmt).isin("nexus", "nex")


def _lexemes(trees: DataFrame) -> DataFrame:
    """(tree, nexus, i, x, statement, piece) of every lexeme but comments.

    ``statement`` counts the semicolons before. ``piece`` is what the lexeme adds to a label.
    """
    found = trees.select(*TREE, _is_nexus(F.col("format")).alias("nexus"),
                         F.posexplode(F.regexp_extract_all("content", F.lit(f"({LEXEMES})"), F.lit(1))).alias("i", "x"))
    order = W.partitionBy(*TREE).orderBy("i")  # the lexemes of one text value
    quoted = (F.length("x") > 1) & F.col("x").rlike(QUOTED)
    before = F.lag("x").over(order)
    doubled = quoted & (F.right("before", F.lit(1)) == F.left("x", F.lit(1))) & F.col("before").rlike(QUOTED)
    inner = F.substr("x", F.lit(2), F.length("x") - 2)
    piece = (F.when(doubled, F.concat(F.left("x", F.lit(1)), inner)).when(quoted, inner)
             .when(F.col("x").rlike(BLANK), F.lit("")).otherwise(F.col("x")))
    rows = found.withColumn("before", before).select(*TREE, "nexus", "i", "x", piece.alias("piece"), quoted.alias("quoted")).filter(~F.col("x").rlike(COMMENT))
    ended = F.sum((F.col("x") == ";").cast("int")).over(order) - (F.col("x") == ";").cast("int")
    return rows.withColumn("statement", ended)


def _statements(lexemes: DataFrame, words) -> DataFrame:
    """(tree, statement, start) of the first NEXUS statement of each tree that begins with one of ``words``, and where that word stands."""
    solid = lexemes.filter(F.col("nexus") & ~F.col("x").rlike(BLANK) & (F.col("x") != ";"))
    first = solid.groupBy(*TREE, "statement").agg(F.min(F.struct("i", "x")).alias("f"))
    named = first.filter(F.upper("f.x").isin(*words)).groupBy(*TREE).agg(F.min(F.struct("statement", F.col("f.i").alias("start"))).alias("s"))
    return named.select(*TREE, "s.*")


def _text(order: str, piece: str, chosen: Column) -> Column:
    """The chosen pieces of one group (the lexemes of a label) put together in order; null if there are none."""
    parts = F.sort_array(F.collect_list(F.when(chosen, F.struct(F.col(order).alias("o"), F.col(piece).alias("p")))))
    return F.when(F.size(parts) > 0, F.array_join(F.transform(parts, lambda e: e["p"]), ""))


def nexus_translate(trees: DataFrame) -> DataFrame:
    """(tree, pos, code, name) of the TRANSLATE block; any text may be a code. Blanks within a name are kept as one."""
    return _translate(_written(trees))


def _written(trees: DataFrame) -> DataFrame:
    """The lexemes of the texts, cut once: what follows reads them several times."""
    return materialize(_lexemes(trees), "lexemes")


def _translate(lexemes: DataFrame) -> DataFrame:
    block = _statements(lexemes, ["TRANSLATE"])
    inside = lexemes.join(block, [*TREE, "statement"]).filter((F.col("i") > F.col("start")) & (F.col("x") != ";"))
    order = W.partitionBy(*TREE).orderBy("i")
    entry = F.sum((F.col("x") == ",").cast("int")).over(order)
    parts = inside.withColumn("pos", entry).filter("x <> ','")
    within = W.partitionBy(*TREE, "pos").orderBy("i")
    solid = ~F.col("x").rlike(BLANK)
    # the first run of blanks after something solid ends the code
    seen = F.max(F.when(solid, F.lit(1)).otherwise(0)).over(within)
    parts = parts.withColumn("ended", F.sum(F.when(~solid & (seen == 1), F.lit(1)).otherwise(0)).over(within))
    parts = parts.withColumn("spaced", F.when(solid, F.col("piece")).otherwise(F.lit(" ")))
    out = parts.groupBy(*TREE, "pos").agg(_text("i", "piece", F.col("ended") == 0).alias("code"), F.trim(_text("i", "spaced", F.col("ended") > 0)).alias("name"))
    return out.select(*TREE, F.col("pos").cast("int").alias("pos"), "code", "name").filter("code <> '' AND name <> ''")


def _tokens(lexemes: DataFrame) -> DataFrame:
    """(tree, pos, tok, label, length): brackets, commas and texts of the tree, numbered.

    The tree is all of a Newick file up to its first semicolon, or what follows the ``=`` of the first
    TREE statement of a NEXUS file. A text has the label before its first colon and the length after it.
    """
    tree = _statements(lexemes, ["TREE", "UTREE"])
    named = lexemes.join(tree, [*TREE, "statement"]).filter("i > start AND x <> ';'")
    begun = F.sum((F.col("x") == "=").cast("int")).over(W.partitionBy(*TREE).orderBy("i").rowsBetween(W.unboundedPreceding, -1))
    named = named.withColumn("begun", begun).filter("begun > 0")
    plain = lexemes.filter(~F.col("nexus") & (F.col("statement") == 0) & (F.col("x") != ";"))
    cols = [*TREE, "i", "x", "piece", "quoted"]
    body = named.select(cols).unionByName(plain.select(cols))
    mark = F.col("x").isin("(", ")", ",")
    body = body.withColumn("part", F.sum(mark.cast("int")).over(W.partitionBy(*TREE).orderBy("i")))
    marks = body.filter(mark).select(*TREE, "i", F.col("x").alias("tok"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("length"))
    texts = body.filter(~mark & ((F.col("piece") != "") | F.col("quoted")))
    colon = (F.col("x") == ":").cast("int")
    texts = texts.withColumn("colons", F.sum(colon).over(W.partitionBy(*TREE, "part").orderBy("i")))
    texts = texts.groupBy(*TREE, "part").agg(F.min("i").alias("i"), _text("i", "piece", F.col("colons") == 0).alias("label"),
                                             F.nullif(F.substr(_text("i", "piece", F.col("colons") > 0), F.lit(2)), F.lit("")).alias("length"))
    tokens = marks.unionByName(texts.select(*TREE, "i", F.lit("text").alias("tok"), "label", "length"))
    return tokens.withColumn("pos", F.row_number().over(W.partitionBy(*TREE).orderBy("i")).cast("long") - 1).drop("i")


def tip_labels(trees: DataFrame) -> DataFrame:
    """(tree, pos, label): distinct tip labels with a letter, in order.

    NEXUS files with a TRANSLATE block give its names, others the labels of their first tree.
    """
    lexemes = _written(trees)
    named = _translate(lexemes).select(*TREE, F.col("pos").cast("long").alias("pos"), F.col("name").alias("label"))
    before = F.lag("tok").over(W.partitionBy(*TREE).orderBy("pos"))
    tips = _tokens(lexemes).withColumn("before", before).filter("tok = 'text' AND coalesce(before, '(') <> ')' AND label IS NOT NULL")
    direct = tips.join(named.select(*TREE).distinct(), TREE, "left_anti").select(*TREE, "pos", "label")
    labels = direct.unionByName(named).filter(F.col("label").rlike("[A-Za-z]"))
    distinct = labels.groupBy(*TREE, "label").agg(F.min("pos").alias("pos"))
    order = W.partitionBy(*TREE).orderBy("pos")  # the labels of one text value
    return distinct.select(*TREE, (F.row_number().over(order) - 1).cast("bigint").alias("pos"), "label")


def tree_nodes(trees: DataFrame) -> DataFrame:
    """(tree, open, close, depth, parent, name, branch_length, is_tip) of every node.

    The depth is the running number of brackets. The k-th opening bracket of a depth belongs to the
    k-th closing one, and a node's parent is the last bracket opened one level above it. A missing
    or bad branch length is 0. Names of NEXUS files are translated.
    """
    # windows below run over the tokens of one text value
    w = W.partitionBy(*TREE).orderBy("pos")
    opened, closed = (F.col("tok") == "(").cast("int"), (F.col("tok") == ")").cast("int")
    lexemes = _written(trees)
    t = _tokens(lexemes).select(*TREE, "pos", "tok", "label", "length", F.lag("tok").over(w).alias("before"),
                              F.lead("tok").over(w).alias("after"), F.lead("label").over(w).alias("next_label"), F.lead("length").over(w).alias("next_length"),
                              (F.sum(opened).over(w) - F.sum(closed).over(w) + closed).alias("level"))
    t = materialize(t, "tokens")  # read five times below; the texts are cut once
    brackets = t.filter(F.col("tok").isin("(", ")")).withColumn(
        "k", F.row_number().over(W.partitionBy(*TREE, "level", "tok").orderBy("pos")))
    named = F.col("after") == "text"
    ends = brackets.filter("tok = ')'").select(*TREE, "level", "k", F.col("pos").alias("close"), F.when(named, F.col("next_label")).alias("label"),
                                               F.when(named, F.col("next_length")).alias("length"))
    inner = brackets.filter("tok = '('").select(*TREE, F.col("pos").alias("open"), "level", "k").join(
        ends, [*TREE, "level", "k"]).drop("k").withColumn("is_tip", F.lit(False))
    tips = t.filter((F.col("tok") == "text") & (F.coalesce("before", F.lit("(")) != ")")).select(
        *TREE, F.col("pos").alias("open"), (F.col("level") + 1).alias("level"), F.col("pos").alias("close"),
        "label", "length", F.lit(True).alias("is_tip"))
    nodes = inner.select(*TREE, "open", "level", "close", "label", "length", "is_tip").unionByName(tips)
    # parents: brackets of a level and the nodes one level below, in text order
    wanted = nodes.select(*TREE, "open", (F.col("level") - 1).alias("at"), F.lit(None).cast("long").alias("bracket"), F.lit(True).alias("node"))
    offered = inner.select(*TREE, "open", F.col("level").alias("at"), F.col("open").alias("bracket"), F.lit(False).alias("node"))
    last = F.last("bracket", True).over(W.partitionBy(*TREE, "at").orderBy("open", F.col("node").desc()))
    parents = wanted.unionByName(offered).withColumn("parent", last).filter("node").select(*TREE, "open", "parent")
    out = nodes.join(parents, [*TREE, "open"]).select(
        *TREE, "open", "close", (F.col("level") - 1).cast("bigint").alias("depth"), "parent", F.nullif("label", F.lit("")).alias("name"),
        F.coalesce(F.col("length").try_cast("double"), F.lit(0.0)).alias("branch_length"), "is_tip")
    codes = _translate(lexemes).select(*TREE, F.col("code").alias("name"), F.col("name").alias("_named"))
    codes = first_per_key(codes, [*TREE, "name"], ["_named"])
    named = out.filter("name IS NOT NULL").join(codes, [*TREE, "name"], "left").withColumn("name", F.coalesce("_named", "name"))
    return named.select(out.columns).unionByName(out.filter("name IS NULL"))


def _clade_sums(nodes: DataFrame, weights: dict[str, Column], block: int = 65536) -> DataFrame:
    """(tree, open) with ``before_x``, the sum of x over earlier tips, and ``x``, the sum over the clade."""
    named = nodes.select(*TREE, "open", "close", "is_tip", *[
        F.when(F.col("is_tip"), F.coalesce(v, F.lit(0))).otherwise(F.lit(0)).alias(n) for n, v in weights.items()])
    event = F.explode(F.when(F.col("is_tip"), F.array(F.struct(F.col("open").alias("at"), F.lit(True).alias("first"), F.lit(True).alias("end"))))
                      .otherwise(F.array(F.struct(F.col("open").alias("at"), F.lit(True).alias("first"), F.lit(False).alias("end")),
                                         F.struct(F.col("close").alias("at"), F.lit(False).alias("first"), F.lit(True).alias("end")))))
    events = named.withColumn("e", event).select(*TREE, "open", *weights, "e.at", "e.first", "e.end")
    run = running_sum(events, TREE, "at", {f"_run_{n}": F.col(n) for n in weights}, block)
    return run.groupBy(*TREE, "open").agg(*[x for n in weights for x in (
        F.max(F.when(F.col("first"), F.col(f"_run_{n}") - F.col(n))).alias(f"before_{n}"),
        (F.max(F.when(F.col("end"), F.col(f"_run_{n}"))) - F.max(F.when(F.col("first"), F.col(f"_run_{n}") - F.col(n)))).alias(n))])


def clade_counts(nodes: DataFrame, tip_counts: DataFrame) -> DataFrame:
    """Nodes with ``occurrence_count``: records linked to a tip, summed over the tips of a clade."""
    counts = tip_counts.select("dataset_id", F.col("tip").alias("name"), F.col("n_records").alias("_n"))
    tips = nodes.filter("is_tip").join(counts, ["dataset_id", "name"], "left")
    counted = tips.unionByName(nodes.filter("NOT is_tip").withColumn("_n", F.lit(None).cast("bigint")))
    sums = _clade_sums(counted, {"occurrence_count": F.col("_n")}).drop("before_occurrence_count")
    return nodes.join(sums, [*TREE, "open"])


def root_distance(nodes: DataFrame, block: int = 65536) -> DataFrame:
    """(tree, open, distance): branch lengths from the root down to and including a node."""
    step = F.explode(F.when(F.col("is_tip"), F.array(F.struct(F.col("open").alias("at"), F.lit(0.0).alias("d"), F.lit(True).alias("first"))))
                     .otherwise(F.array(F.struct(F.col("open").alias("at"), F.col("branch_length").alias("d"), F.lit(True).alias("first")),
                                        F.struct(F.col("close").alias("at"), (-F.col("branch_length")).alias("d"), F.lit(False).alias("first")))))
    steps = nodes.select(*TREE, "open", "is_tip", "branch_length", step.alias("s")).select(
        *TREE, "open", "is_tip", "branch_length", "s.*")
    run = running_sum(steps, TREE, "at", {"_run": F.col("d")}, block).filter("first")
    own = F.when(F.col("is_tip"), F.col("branch_length")).otherwise(F.lit(0.0))
    return run.select(*TREE, "open", (F.col("_run") + own).alias("distance"))


def clade_shape(nodes: DataFrame) -> DataFrame:
    """(tree, open, preorder, n_tips, first_leaf, longest_path) of every node.

    The longest path below a node is a range maximum over its leaves: leaf distances are combined
    per aligned power-of-two block, and each clade reads the few blocks that make up its leaf range.
    """
    w = W.partitionBy(*TREE).orderBy("open")  # the nodes of one text value
    order = nodes.select(*TREE, "open", "is_tip", (F.row_number().over(w) - 1).cast("bigint").alias("preorder"))
    sums = _clade_sums(nodes, {"n_tips": F.lit(1).cast("bigint")}).withColumnRenamed("before_n_tips", "first_leaf")
    located = order.join(sums, [*TREE, "open"]).join(root_distance(nodes), [*TREE, "open"])
    parts = located.filter("n_tips > 0").select(*TREE, "open", F.explode(
        cover(F.col("first_leaf"), F.col("first_leaf") + F.col("n_tips"))).alias("b")).select(*TREE, "open", "b.*")
    leaves = in_blocks(located.filter("is_tip").select(*TREE, "distance", "first_leaf"), F.col("first_leaf"), parts)
    peaks = leaves.groupBy(*TREE, "level", "block").agg(F.max("distance").alias("peak"))
    highest = parts.join(peaks, [*TREE, "level", "block"]).groupBy(*TREE, "open").agg(F.max("peak").alias("peak"))
    return located.join(highest, [*TREE, "open"], "left").select(
        *TREE, "open", "preorder", "n_tips", "first_leaf",
        F.coalesce(F.col("peak") - F.col("distance"), F.lit(0.0)).alias("longest_path"))


def clade_tips(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(tree, node, pos, label): tips below the chosen nodes (tree, node = open position)."""
    chosen = (nodes.select(*TREE, F.col("open").alias("node"), "close").join(wanted.select(*TREE, "node").distinct(), [*TREE, "node"])
              .withColumn("_end", F.col("close") + 1))
    tips = nodes.filter("is_tip").select(*TREE, F.col("open").alias("pos"), F.col("name").alias("label"))
    return points_in_intervals(chosen, tips, TREE, "node", "_end", "pos").select(*TREE, "node", "pos", "label")


def link_status(nodes: DataFrame, tip_counts: DataFrame) -> DataFrame:
    """Per tree: linked and total tips, percent, whether any link and any coordinates exist."""
    known = tip_counts.select("dataset_id", F.col("tip").alias("name"), F.lit(True).alias("_linked"), "has_coordinates")
    joined = nodes.filter("is_tip").join(known, ["dataset_id", "name"], "left")
    n, k = F.count(F.lit(1)), F.count("_linked")
    return joined.groupBy(*TREE).agg(
        k.alias("linked_tips"), n.alias("total_tips"), F.round(k * 100.0 / n).cast("bigint").alias("percent"),
        (k > 0).alias("has_links"), F.coalesce(F.bool_or("has_coordinates"), F.lit(False)).alias("has_coordinates"))


def search_tips(nodes: DataFrame, q: str, n: int = 10) -> DataFrame:
    """Per tree the first tips whose label contains the text, ignoring case."""
    found = nodes.filter(F.col("is_tip") & F.contains(F.lower("name"), F.lower(F.lit(q))))
    return top_k(found.select(*TREE, F.col("open").alias("pos"), F.col("name").alias("label")), TREE, ["pos"], n)


def tree_summary(files: DataFrame, preview: int = 500, labels: int = 50) -> DataFrame:
    """Per tree file: start of the text, first labels, number of labels, whether the list is cut.

    ``files`` is (tree, path, format, content, error); a file that could not be read keeps its
    error note instead of a preview.
    """
    found = tip_labels(files.filter("error IS NULL"))
    count = found.groupBy(*TREE).agg(F.count(F.lit(1)).alias("n_labels"))
    listed = joined_ranked(found.filter(F.col("pos") < labels), TREE, "pos", F.col("label"), ", ", "labels")
    text = F.when(F.length("content") > preview, F.concat(F.left("content", F.lit(preview)), F.lit("..."))).otherwise(F.col("content"))
    note = F.concat(F.lit("[Error reading file: "), F.col("error"), F.lit("]"))
    return (files.join(count, TREE, "left").join(listed, TREE, "left").select(
        *TREE, "path", F.when(F.col("error").isNotNull(), note).otherwise(text).alias("preview"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("n_labels", F.lit(0)).cast("bigint").alias("n_labels"),
        (F.coalesce("n_labels", F.lit(0)) > labels).alias("truncated")))
