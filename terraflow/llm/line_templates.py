"""Line dedup by a tree of log templates, DataFrame functions only.

The tree has a fixed depth: a line goes to the leaf of its token count and its leading
tokens, tokens with a digit being fields ``<*>`` from the start. Below the leaf, the other
places are cut into as many stretches as a template may have fields, plus one: two lines of
a leaf that differ at no more places than that share one. A stretch that several
different lines of two documents or more share is a branch, and a line goes to all of
its own. In a branch, the template has at each place the token that most of the different lines have there. Lines
that agree with it at ``similarity`` of all places are its members, and the places where
members differ are its fields. Templates that share a member are one. So whether a token is
constant depends on the lines around it alone, not on how often its value is met in the corpus.

Templates that recur across documents are dropped: all lines of such a template but the
first go. Only branches of several different lines are taken to tokens. Everything before works on
hashes of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraflow.llm.common import materialize, sized
from terraflow.llm.graph import components

FIELD = "<*>"
#: A token with a digit, from the start of the token on.
WITH_DIGIT = r"(?<!\S)[^\s0-9]*+[0-9]\S*"


def masked_line(line: Column) -> Column:
    """The line between its outer blanks, tabs as blanks, tokens with a digit as fields."""
    blank = F.when(F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")), F.translate(line, "\t\r", "  ")).otherwise(line)
    bare = F.trim(blank)
    return F.when(bare.rlike("[0-9]"), F.regexp_replace(bare, WITH_DIGIT, FIELD)).otherwise(bare)


def token_count(line: Column) -> Column:
    """Tokens between single blanks."""
    return F.size(F.split(line, " "))


def _document(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def _lines(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    # Inside of the array each line is masked and counted once, however often the columns are used below.
    masked = F.transform(F.split("text", "\n"), masked_line)
    counted = F.transform(masked, lambda m: F.struct(m.alias("line"), token_count(m).alias("n")))
    rows = docs.select("doc_id", _document(F.col("doc_id"), F.col("text")).alias("doc"), F.posexplode(counted).alias("line_no", "l"))
    rows = rows.select("doc_id", "doc", "line_no", "l.line", "l.n").filter((F.col("n") >= min_tokens) & (F.col("line") != ""))
    leaf = F.xxhash64("n", F.substring_index("line", " ", depth)).alias("leaf")
    return rows.select("doc_id", "doc", "line_no", "n", "line", leaf, F.xxhash64("line").alias("hash"))


def _stretches(lines: DataFrame, depth: int, similarity: float) -> DataFrame:
    """node, low, high, fields (as many as its template may have) and branch of each different line, one row for each stretch of its places."""
    tokens, n = F.split("line", " "), token_count(F.col("line"))
    fields = n - F.ceil(F.lit(similarity) * n).cast("int")
    rows = lines.select("leaf", "node", "low", "high", tokens.alias("w"), F.greatest(n - depth, F.lit(1)).alias("rest"), fields.alias("fields"))
    rows = rows.withColumn("parts", F.least(F.col("fields") + 1, "rest"))

    def edge(s: Column) -> Column:
        return F.floor((s * F.col("rest") + F.col("parts") - 1) / F.col("parts")).cast("int")

    def branch(s: Column) -> Column:
        return F.xxhash64("leaf", s, F.array_join(F.slice("w", depth + 1 + edge(s), edge(s + 1) - edge(s)), " "))

    return rows.select("node", "low", "high", "fields", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), branch)).alias("branch"))


def _branches(lines: DataFrame, depth: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The branches (branch, lines, fields and hub, one of its lines), and branch and node of all their different lines.

    Branches of the same lines have the same template, so one of them stands for all; lines are told by two hashes.
    """
    stretches = materialize(_stretches(lines, depth, similarity), "stretches")
    same = [F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    ends = [F.min("low").alias("low"), F.max("high").alias("high"), F.min("node").alias("hub"), F.min("fields").alias("fields")]
    several = stretches.groupBy("branch").agg(F.count(F.lit(1)).alias("lines"), *ends, *same).filter("lines > 1 AND low < high")
    branches = materialize(several.groupBy("x", "y", "lines", "fields", "hub").agg(F.min("branch").alias("branch")).drop("x", "y"), "branches")
    return branches, stretches.select("branch", "node").join(sized(branches.select("branch"), 24), "branch")


def _members(lines: DataFrame, depth: int, similarity: float) -> DataFrame:
    """branch and node of the lines that agree with the template of a branch.

    Lines are held by their differences from the hub of the branch, the template too.
    """
    branches, held = _branches(lines, depth, similarity)
    texts = lines.select("node", "line")
    others = materialize(held.join(branches, "branch").filter("node <> hub"), "branch-lines")
    both = others.join(texts, "node").join(texts.select(F.col("node").alias("hub"), F.col("line").alias("base")), "hub")
    pairs = F.zip_with(F.split("line", " "), F.split("base", " "), lambda a, b: F.struct(a.alias("token"), b.alias("base")))
    placed = F.transform(pairs, lambda p, i: F.struct(i.alias("at"), p["token"].alias("token"), p["base"].alias("base")))
    unlike = F.filter(placed, lambda p: p["token"] != p["base"])
    unlike = materialize(both.select("branch", "node", "lines", "fields", unlike.alias("d")), "branch-differences")

    counts = unlike.select("branch", "lines", F.inline("d")).groupBy("branch", "lines", "at", "base", "token").agg(F.count(F.lit(1)).alias("c"))
    most = counts.groupBy("branch", "lines", "at", "base").agg(F.max(F.struct("c", "token")).alias("m"), (F.col("lines") - F.sum("c")).alias("c"))
    moved = most.filter(F.col("m") > F.struct("c", F.col("base").alias("token"))).groupBy("branch")
    moved = moved.agg(F.collect_list("at").alias("t_at"), F.collect_list(F.xxhash64("at", "m.token")).alias("t"))
    template = sized(materialize(moved, "branch-templates"), 2000)

    agreed = F.array_intersect(F.transform("d", lambda p: F.xxhash64(p["at"], p["token"])), "t")
    wrong = F.when(F.col("t").isNull(), F.size("d")).otherwise(F.size(F.array_union("d.at", "t_at")) - F.size(agreed))
    found = unlike.join(template, "branch", "left").filter(wrong <= F.col("fields")).select("branch", "node")
    of_hub = F.when(F.col("t").isNull(), 0).otherwise(F.size("t"))
    return found.union(branches.join(template, "branch", "left").filter(of_hub <= F.col("fields")).select("branch", "hub"))


def line_templates(docs: DataFrame, depth: int = 3, min_tokens: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, doc, line_no and template (a hash) of the lines in leaves of two or more documents.

    ``docs`` has doc_id and text. A line that is no member of a template of
    several lines is a template of its own, its fields being the tokens with a digit.
    """
    hashes = materialize(_lines(docs, depth, min_tokens).select("doc_id", "doc", "line_no", "leaf", "hash"), "lines")
    different = hashes.groupBy("leaf", "hash").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    leaves = different.groupBy("leaf").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("lines"))
    leaves = materialize(leaves.filter("low < high").select("leaf", (F.col("lines") > 1).alias("mixed")), "leaves")
    mixed = materialize(leaves.filter("mixed").select("leaf"), "mixed-leaves")

    texts = _lines(docs, depth, min_tokens).join(sized(mixed, 16), "leaf", "left_semi")
    texts = texts.groupBy("leaf", "hash").agg(F.first("line").alias("line"), F.min("doc").alias("low"), F.max("doc").alias("high"))
    texts = materialize(texts.withColumn("node", F.xxhash64("leaf", "hash")), "mixed-lines")
    members = materialize(_members(texts, depth, similarity).withColumnRenamed("node", "a"), "members")
    hubs = members.groupBy("branch").agg(F.min("a").alias("b"))
    joined = components(members.join(hubs, "branch").select("a", "b"))

    lines = hashes.join(sized(leaves.select("leaf"), 16), "leaf", "left_semi").withColumn("node", F.xxhash64("leaf", "hash")).join(sized(joined, 32), "node", "left")
    return lines.select("doc_id", "doc", "line_no", F.coalesce("label", "node").alias("template"))


def recurring_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """doc_id, doc and line_no of the lines to drop: all but the first of each template of ``min_docs`` documents or more."""
    lines = materialize(lines, "line-templates")
    # Null ids come last, so a named document keeps the line.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("line_no"))).alias("first")
    stats = lines.groupBy("template").agg(F.count_distinct("doc").alias("docs"), first)
    stats = materialize(stats.filter(F.col("docs") >= min_docs).select("template", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line")), "recurring")
    again = ~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("line_no") == F.col("first_line")))
    return lines.join(sized(stats, 32), "template").filter(again).select("doc_id", "doc", "line_no")


def drop_recurring_lines(
    docs: DataFrame, min_docs: int = 2, depth: int = 3, min_tokens: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents with all their columns, recurring lines taken out of the text, and ``__dropped``.

    Lines end at ``\\n``. Lines of fewer than ``min_tokens`` tokens stay. The
    first line of a template, by doc_id and place, stays (null ids come last);
    rows equal in id and text are one document and keep the same lines. Null
    text stays null, empty text empty; documents stay even if no line is left.
    Extra columns pass through.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    drop = recurring_lines(line_templates(plain, depth, min_tokens, similarity), min_docs)
    # One flag for each line up to the last one dropped, written out: a line is looked up by its number.
    hits = drop.groupBy("doc").agg(F.sort_array(F.collect_set("line_no")).alias("gone"))

    def flags(at: Column, i: Column) -> Column:
        before = F.coalesce(F.get("gone", i - 1), F.lit(-1))
        return F.concat(F.array_repeat(F.lit(False), at - before - 1), F.array(F.lit(True)))

    hits = materialize(hits.select("doc", F.size("gone").cast("long").alias("__n"), F.flatten(F.transform("gone", flags)).alias("__gone")), "line-hits")
    lines = F.split(F.col(text), "\n")
    left = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.coalesce(F.get("__gone", s["i"]), F.lit(False)))
    kept = F.array_join(F.transform(left, lambda s: s["x"]), "\n")
    keyed = docs.withColumn("__doc", _document(F.col(doc_id), F.col(text)))
    joined = keyed.join(sized(hits.withColumnRenamed("doc", "__doc"), 200).hint("shuffle_hash"), "__doc", "left")
    columns = [F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept).alias(text) if c == text else F.col(c) for c in docs.columns]
    return joined.select(*columns, F.coalesce("__n", F.lit(0)).cast("long").alias("__dropped"))
