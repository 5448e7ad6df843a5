"""Quoted passages of messages, linked to the messages that they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.llm.tables import as_row, given, join_same, let, whole
from varve.shared import col, materialize


def normal_hash(passage: Column) -> Column:
    """SHA-256 of the passage in lower case with single spaces; null if nothing is left."""
    plain = F.trim(F.regexp_replace(F.lower(passage), r"\s+", " "))
    return F.when(plain != "", F.sha2(plain, 256))


def quote_runs(text: Column) -> Column:
    """Runs of lines of one quote level, in order: (level, content).

    The level is the number of ``>`` that a line starts with, blanks between them allowed.
    """
    lines = F.split(text, r"\r?\n")
    prefix = lambda line: F.regexp_extract(line, r"^[>\x20\t]*", 0)
    level = lambda line: F.length(prefix(line)) - F.length(F.replace(prefix(line), F.lit(">"), F.lit("")))
    content = lambda line: F.when(level(line) > 0, F.substring(line, F.length(prefix(line)) + 1, F.length(line))).otherwise(line)
    parsed = F.transform(lines, lambda line: F.struct(level(line).alias("level"), content(line).alias("content")))

    def runs(parsed):
        at = lambda i: F.get(parsed, i - 1)
        new = lambda i: F.when(i == 1, True).otherwise(at(i)["level"] != at(i - 1)["level"])

        def cut(starts):
            run = lambda s, j: F.slice(parsed, s, F.coalesce(F.get(starts, j + 1), F.size(parsed) + 1) - s)["content"]
            joined = lambda s, j: F.array_join(run(s, j), "\n")
            return F.transform(starts, lambda s, j: F.struct(at(s)["level"].alias("level"), joined(s, j).alias("content")))

        return let(F.filter(F.sequence(F.lit(1), F.size(parsed)), new), cut)

    return let(parsed, runs)


def own_text(runs: Column) -> Column:
    """What is not quoted."""
    return F.array_join(F.transform(F.filter(runs, lambda r: r["level"] == 0), lambda r: r["content"]), "\n")


def _units(content: Column) -> Column:
    """The hash of a passage, and the hashes of its lines: (rank, hash), rank 0 for the whole."""
    lines = F.transform(F.split(content, "\n"), lambda line: F.struct(F.lit(1).alias("rank"), normal_hash(line).alias("hash")))
    first = F.array(F.struct(F.lit(0).alias("rank"), normal_hash(content).alias("hash")))
    return F.array_distinct(F.filter(F.concat(first, lines), lambda u: u["hash"].isNotNull()))


def link_quotes(messages: DataFrame) -> DataFrame:
    """Each message without its quotes, with the message that it answers, in reply order.

    ``messages`` has ``conv_id``, ``turn`` and ``text``; other columns are kept. A quoted passage (a
    run of lines of one level) belongs to the first message of its conversation that says it
    itself and comes before the quoting one: as a whole, or else by one of its lines. A message
    answers the origin of its outermost linked passage, the latest of them on ties. Adds ``body``,
    ``n_quoted``, ``n_linked``, ``parent_turn``, ``root_turn`` and ``depth``, and sorts by
    conversation, root, depth and turn: replies follow what they answer. A null text is empty;
    messages with a null conversation or turn, and those without linked quotes, are roots.
    Repeated rows are linked alike. An added column takes the place of a given one of its name. No conversation is gathered in one task: links are joins on
    unique keys, and roots are found by doubling pointers.
    """
    added = ["conv_id", "turn", "body", "n_quoted", "n_linked", "parent_turn", "root_turn", "depth"]
    runs = quote_runs(whole("text"))
    parsed = materialize(messages.select("conv_id", "turn", as_row(messages), F.xxhash64(whole("text")).alias("_text"), runs.alias("_runs")))
    body = own_text(F.col("_runs"))
    said = parsed.select("conv_id", "turn", F.explode(F.concat(_units(body), F.flatten(F.transform(
        F.filter("_runs", lambda r: r["level"] == 0), lambda r: _units(r["content"])))).alias("u")).alias("u"))
    origins = materialize(said.groupBy("conv_id", F.col("u.hash").alias("hash")).agg(F.min("turn").alias("origin")))
    quoted = parsed.select("conv_id", "turn", "_text", F.posexplode("_runs").alias("place", "run")).filter("run.level > 0")
    asked = quoted.select("conv_id", "turn", "_text", "place", F.col("run.level").alias("level"), F.explode(_units(F.col("run.content"))).alias("u"))
    found = asked.select("conv_id", "turn", "_text", "place", "level", "u.rank", F.col("u.hash").alias("hash")).join(
        origins, ["conv_id", "hash"]
    ).filter("origin < turn")
    passage = found.groupBy("conv_id", "turn", "_text", "place", "level").agg(F.min(F.struct("rank", (-F.col("origin")).alias("back"))).alias("best"))
    links = passage.groupBy("conv_id", "turn", "_text").agg(
        F.count("*").alias("n_linked"), (-F.min(F.struct("level", "best.back"))["back"]).alias("parent_turn")
    )
    rows = join_same(parsed, links, ["conv_id", "turn", "_text"])
    linked = materialize(
        rows.select(
            "conv_id", "turn", *given(messages.columns, added), body.alias("body"),
            F.size(F.filter("_runs", lambda r: r["level"] > 0)).cast("long").alias("n_quoted"),
            F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "parent_turn",
        )
    )
    roots = thread_roots(linked)
    joined = join_same(linked, roots, ["conv_id", "turn"])
    return joined.select(
        *map(col, linked.columns), F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth")
    ).orderBy("conv_id", "root_turn", "depth", "turn")


def thread_roots(linked: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``root_turn`` and ``depth`` of every reply, by pointers that double in each round.

    Of messages that share a conversation and turn, the latest parent counts. Parents come before
    their replies, so there are no cycles, and d rounds reach a depth of 2 to the power d. A reply
    whose pointer has reached a root takes part in no further round, so a few long
    conversations do not make the others be joined again.
    """
    nodes = linked.filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.max("parent_turn").alias("up"))
    replies = materialize(nodes.filter("up is not null"))
    parents = replies.select("conv_id", F.col("turn").alias("up"), F.lit(True).alias("open"))
    flagged = replies.join(parents, ["conv_id", "up"], "left")
    current = materialize(
        flagged.select("conv_id", "turn", F.col("up").alias("root_turn"), F.lit(1).alias("depth"), F.coalesce("open", F.lit(False)).alias("open"))
    )
    settled = current.filter("not open")
    while not current.filter("open").isEmpty():
        pointers = settled.unionByName(current.filter("open")).select(
            "conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("next"), F.col("depth").alias("more"), F.col("open").alias("on")
        )
        step = current.filter("open").join(pointers, ["conv_id", "root_turn"])
        depth = (F.col("depth") + F.col("more")).alias("depth")
        current = materialize(step.select("conv_id", "turn", F.col("next").alias("root_turn"), depth, F.col("on").alias("open")))
        settled = settled.unionByName(current.filter("not open"))
    return settled.drop("open")
