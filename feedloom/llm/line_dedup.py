"""Line dedup with a log-template tree of fixed depth.

A line's tokens (runs of other than ASCII white space) go down the tree by their
number and by the first ``depth`` tokens, where a token with a digit counts as
the variable field ``<*>``.  In a leaf every further position is generalised: a
token that does not recur there in ``min_docs`` documents is a variable field
too.  The line with its variable fields replaced is its template.  A template
recurs if it has lines in at least ``min_docs`` documents, is not generalised in
more than ``1 - similarity`` of its positions, and at least half of its tokens
are constant.  Lines of recurring templates are dropped everywhere but in the
first document (smallest doc_id), so that no text is lost from the corpus.
Lines of fewer than ``min_tokens`` tokens have no variable fields: with ``short``
their tokens as they are make the leaf and the template.

The usual parser of this kind updates templates line by line, in an order.
Here each level is an aggregation over the whole table, so results do not depend
on an order.  Leaves of fewer than ``min_docs`` documents end the search early;
lines of equal tokens are counted once per document and collapsed before their
tokens are looked at, so a line in a third of all documents is one row there.
(A token's count sums the documents of its distinct lines.)  Lines, leaves and
templates travel as 128-bit keys; a text leaves its task only for leaves that can
be frequent.

``without_repeated_passages`` is for what recurs in fewer documents: a line of
passage length is no chance repetition, so an exact copy goes from the second
document on, and a few documents are enough for a template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import Workspace, saved

VARIABLE = "<*>"
LEAF_BUCKETS = 1 << 20
TEMPLATE = ["la", "lb", "ta", "tb"]
_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"


def _tokens(line: Column) -> Column:
    # by a single character: Java cuts at that without a pattern, which it would compile anew for every line
    return F.filter(F.split(F.regexp_replace(line, r"[\x09-\x0D]", " "), " "), lambda t: t != "")


def _joined(line: Column) -> Column:
    """The line's tokens joined by one space.  Most lines are that already, and
    telling so is cheaper than cutting them."""
    spaced = line.rlike(r"[\x09-\x0D]") | F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    return F.when(spaced, F.array_join(_tokens(line), " ")).otherwise(line)


def _masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(token)


def _lines(docs: DataFrame, depth: int, min_tokens: int, short: bool) -> DataFrame:
    """``(doc_id, text, leaf, short)`` of the lines that are long enough, with
    ``short`` of all that have a token; ``text`` is the tokens joined by one space."""
    # by a pattern: a filter on the number of tokens would cut each line into tokens twice
    enough = rf"^(?:{_SPACE}+)?(?:{_WORD}++{_SPACE}+){{{0 if short else min_tokens - 1}}}{_WORD}"
    lines = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.split(F.col("text").cast("string"), "\n", -1)).alias("line")) \
        .where(F.col("line").rlike(enough)).select("doc_id", _joined(F.col("line")).alias("text"))
    # selects of their own, so that each line is joined and counted once
    lines = lines.select("doc_id", "text", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).alias("n"))
    head = F.transform(F.split(F.substring_index("text", " ", depth), " "), _masked) if depth else F.array().cast("array<string>")
    head = F.when(F.col("n") < min_tokens, F.split("text", " ")).otherwise(head) if short else head
    return lines.select("doc_id", "text", F.concat_ws(" ", F.col("n").cast("string"), head).alias("leaf"),
                        (F.col("n") < min_tokens).alias("short"))


def _bits(text: Column, first: str, second: str) -> list[Column]:
    """128 bits of a text."""
    return [F.xxhash64(text).alias(first), F.xxhash64(F.lit(1), text).alias(second)]


def _keys(lines: DataFrame, passage: int | None = None) -> DataFrame:
    """``(doc_id, a, b, la, lb, short)``: lines and leaves by 128-bit keys; with
    ``passage`` also whether the line has so many tokens."""
    n_tokens = F.substring_index("leaf", " ", 1).cast("int")
    return lines.select("doc_id", *_bits(F.col("text"), "a", "b"), *_bits(F.col("leaf"), "la", "lb"), "short",
                        *([] if passage is None else [(n_tokens >= passage).alias("passage")]))


def _templates(lines: DataFrame, keys: DataFrame, work: Workspace, min_docs: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``keys`` with their templates, and the recurring templates.  The texts of
    ``lines`` are read for the keys of frequent leaves only."""
    leaves = work.saved(keys.groupBy("la", "lb").agg(F.countDistinct("doc_id").alias("n")).where(F.col("n") >= min_docs)
                        .select("la", "lb"), "leaves")
    # Sorted merge at every size: the table of leaves grows with the corpus, and hot leaves can be split.
    keys = work.saved(keys.join(leaves.hint("merge"), ["la", "lb"], "left_semi"), "leaf-lines")
    keys = work.saved(keys.distinct(), "document-lines")  # on its own, so that hot leaves stay split above
    kinds = work.saved(keys.groupBy("a", "b", "la", "lb", "short").agg(F.count("*").alias("n")), "leaf-kinds")
    # Texts leave their task only if their leaf's bucket has a frequent leaf: at most LEAF_BUCKETS numbers to broadcast.
    hot = leaves.select(F.pmod("la", F.lit(LEAF_BUCKETS)).alias("bucket")).distinct()
    texts = lines.where(~F.col("short")).select("text", F.pmod(F.xxhash64("leaf"), F.lit(LEAF_BUCKETS)).alias("bucket")) \
        .join(F.broadcast(hot), "bucket", "left_semi").select("text", *_bits(F.col("text"), "a", "b")).groupBy("a", "b").agg(F.first("text").alias("text"))
    long_kinds = work.saved(texts.join(kinds.where(~F.col("short")).hint("merge"), ["a", "b"]), "kind-texts")
    tokens = long_kinds.select("a", "b", "la", "lb", "n", F.posexplode(F.transform(_tokens(F.col("text")), _masked)).alias("pos", "token"))
    constant = work.saved(tokens.groupBy("la", "lb", "pos", "token").agg(F.sum("n").alias("n"))
                          .where((F.col("n") >= min_docs) | (F.col("token") == VARIABLE))
                          .select("la", "lb", "pos", "token", F.lit(True).alias("kept")), "leaf-constants")
    field = F.when(F.col("kept"), F.col("token")).otherwise(VARIABLE)
    named = tokens.join(constant, ["la", "lb", "pos", "token"], "left").groupBy("a", "b").agg(
        F.sort_array(F.collect_list(F.struct("pos", field.alias("field")))).alias("fields"),
        F.avg(F.when(F.col("kept"), 1.0).otherwise(0.0)).alias("kept"),
        F.avg(F.when(F.col("kept") & (F.col("token") != VARIABLE), 1.0).otherwise(0.0)).alias("constant")) \
        .where((F.col("kept") >= similarity) & (F.col("constant") >= 0.5)) \
        .select("a", "b", *_bits(F.concat_ws(" ", F.col("fields.field")), "ta", "tb"))
    named = named.union(kinds.where("short").select("a", "b", F.col("la").alias("ta"), F.col("lb").alias("tb")))
    named = work.saved(named, "templates")
    found = work.saved(keys.join(named, ["a", "b"]).select("doc_id", "a", "b", *TEMPLATE), "template-lines")
    recurring = work.saved(found.groupBy(*TEMPLATE).agg(
        F.countDistinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))
        .where(F.col("n_docs") >= min_docs), "recurring")
    return found, recurring


def _later(found: DataFrame, recurring: DataFrame) -> DataFrame:
    """``(doc_id, a, b)`` of the lines of recurring templates outside the first document."""
    return found.join(recurring, TEMPLATE).where("doc_id <> first_doc").select("doc_id", "a", "b")


def _by_document(gone: DataFrame) -> DataFrame:
    return gone.groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("gone"))


def dropped_lines(docs: DataFrame, min_docs: int = 20, depth: int = 3, similarity: float = 0.8,
                  min_tokens: int = 3, short: bool = True, passage: int | None = None) -> DataFrame:
    """``(doc_id, gone)``: the 128-bit keys ``(a, b)`` of the tokens of the lines
    to drop from each document.  With ``passage`` also copies of lines of that
    many tokens or more, from the second document on."""
    lines = _lines(docs, depth, min_tokens, short)
    with Workspace(docs.sparkSession, "lines") as work:
        keys = work.saved(_keys(lines, passage), "line-keys")
        found, recurring = _templates(lines, keys.drop("passage"), work, min_docs, similarity)
        gone = _later(found, recurring)
        if passage is not None:
            gone = gone.union(_marked(keys.where("passage").select("doc_id", "a", "b"), work).where("copy").select("doc_id", "a", "b"))
        return saved(_by_document(gone), "dropped-lines")


def _copies(keys: DataFrame, work: Workspace) -> DataFrame:
    """``keys`` with ``copy``: whether an earlier document has the line too."""
    return work.saved(_marked(work.saved(keys, "passage-keys"), work), "marked-passages")


def _marked(keys: DataFrame, work: Workspace) -> DataFrame:
    copied = work.saved(keys.groupBy("a", "b").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
                        .where("first_doc <> last_doc").select("a", "b", "first_doc"), "copied-passages")
    # Sorted merge, so that the rows of a passage in very many documents can be split.
    return keys.join(copied.hint("merge"), ["a", "b"], "left").withColumn(
        "copy", F.coalesce(F.col("doc_id") != F.col("first_doc"), F.lit(False))).drop("first_doc")


def without_copied_lines(docs: DataFrame, min_tokens: int = 8) -> DataFrame:
    """``docs`` without lines of ``min_tokens`` tokens or more whose tokens are a
    line of an earlier document too (smaller doc_id); rows and columns as in
    ``without_recurring_lines``."""
    with Workspace(docs.sparkSession, "copies") as work:
        keys = _copies(_keys(_lines(docs, 0, min_tokens, False)), work)
        gone = saved(_by_document(keys.where("copy")), "dropped-copies")
    return _rest(_cut(docs, gone), docs.columns)


def without_repeated_passages(docs: DataFrame, min_tokens: int = 8, min_docs: int = 5, depth: int = 3,
                              similarity: float = 0.8, without: DataFrame | None = None) -> DataFrame:
    """``without_copied_lines``, and of what it leaves no lines of templates of
    ``min_tokens`` tokens or more that recur in ``min_docs`` documents.  Documents
    whose id is in ``without(doc_id)`` go whole and do not count.  Texts are
    shuffled for the join that cuts them, lines only where their leaf is frequent."""
    lines = _lines(docs, depth, min_tokens, False)
    with Workspace(docs.sparkSession, "passages") as work:
        keys = _keys(lines)
        if without is not None:
            keys = keys.join(without.select("doc_id"), "doc_id", "left_anti")
        keys = _copies(keys, work)
        found, recurring = _templates(lines, keys.where("not copy").drop("copy"), work, min_docs, similarity)
        gone = saved(_by_document(keys.where("copy").select("doc_id", "a", "b").union(_later(found, recurring))), "dropped-passages")
    if without is not None:  # in one join with the lines, so that texts are shuffled once
        whole = without.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast(gone.schema["gone"].dataType).alias("gone"))
        gone = gone.withColumn("whole", F.lit(False)).union(whole.withColumn("whole", F.lit(True)))
    return _rest(_cut(docs, gone), docs.columns)


def _cut(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` as struct ``row`` with arrays ``all`` and ``kept`` of its lines;
    ``gone(doc_id, gone)`` has the keys of the lines to drop, and ``whole`` (if
    there is such a column) says that the document goes.  A sorted merge at every
    size: ``gone`` grows with the corpus."""
    if "whole" not in gone.columns:
        gone = gone.withColumn("whole", F.lit(False))
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    every = F.when(F.length("row.text") > 0, F.split("row.text", "\n", -1)).otherwise(F.array().cast("array<string>"))
    return packed.join(gone.withColumnRenamed("doc_id", "of").hint("merge"), F.col("id") == F.col("of"), "left") \
        .where(~F.coalesce("whole", F.lit(False))) \
        .select("row", "gone", every.alias("all")) \
        .select("row", "all", F.when(F.col("gone").isNull(), F.col("all")).otherwise(
            F.filter("all", lambda x: ~F.array_contains("gone", F.struct(*_bits(_joined(x), "a", "b"))))).alias("kept"))


def _split(docs: DataFrame, **parameters) -> DataFrame:
    return _cut(docs, dropped_lines(docs, **parameters))


def _rest(cut: DataFrame, columns: list[str]) -> DataFrame:
    cut = cut.withColumn("touched", F.size("all") > F.size("kept")) \
        .withColumn("text", F.when(F.col("touched"), F.array_join("kept", "\n")).otherwise(F.col("row.text"))) \
        .where(~F.col("touched") | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("touched"), F.length("text").cast("long"))
           .otherwise(F.col("row.n_chars")) if "n_chars" in columns else None}
    return cut.select([new[c].alias(c) if new.get(c) is not None else F.col(f"row.`{c}`").alias(c) for c in columns])


def dedup(docs: DataFrame, **parameters) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, n_lines, n_dropped, kept)``.

    ``kept`` joins the remaining lines by line feeds.  Null and empty texts have
    no lines.  Rows without an id are not counted and stay whole; rows with one
    id count as one document.  Other columns are ignored."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return _split(docs, **parameters).select(
        "row.doc_id", F.size("all").cast("long").alias("n_lines"),
        (F.size("all") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("kept"))


def without_recurring_lines(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the lines of recurring templates; same columns.  ``text``
    and, if there is one, ``n_chars`` change; a document of which nothing but
    white space is left goes, an untouched one stays as it is."""
    return _rest(_split(docs, **parameters), docs.columns)
