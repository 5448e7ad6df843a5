"""Secrets in texts, and how widely each is copied over the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.llm.tables import join_same, let, whole
from varve.shared import materialize

# Fixed patterns. A value of the assignment counts from 6 characters.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"

ORDER = ("assign", "access", "hex", "example", "live")
SPAN = "array<struct<start:int,stop:int,value:string>>"
BLOCK = 128
# A value found by its name or form looks live from this share of the bits that its length allows.
VARIED = 0.47


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, stop, value), counted in code points.

    The pieces between the matches give the offsets. ``value`` is the given group. An array that grows is
    copied at each step, so matches are folded in blocks of ``BLOCK`` that are joined at the end: the work
    stays about in proportion to their number, however many one text holds.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), values.alias("value"))
    parts = F.transform(
        zipped, lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.length(p["hit"]).alias("hit"), p["value"].alias("value"))
    )

    def step(state, part):
        begin = state["at"] + part["gap"]
        end = begin + part["hit"]
        span = F.struct(begin.alias("start"), end.alias("stop"), part["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    def block(state, own):
        start = F.struct(state["at"].alias("at"), F.array().cast(SPAN).alias("spans"))
        return let(
            F.aggregate(own, start, step),
            lambda done: F.struct(done["at"].alias("at"), F.concat(state["blocks"], F.array(done["spans"])).alias("blocks")),
        )

    def folded(parts):
        last = F.size(parts) - 1  # what follows the last match is no match
        numbers = F.sequence(F.lit(0), F.greatest(F.ceil(last / BLOCK) - 1, F.lit(0)).cast("int"))
        blocks = F.transform(numbers, lambda i: F.slice(parts, i * BLOCK + 1, F.least(F.lit(BLOCK), last - i * BLOCK)))
        none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("blocks"))
        return F.flatten(F.aggregate(blocks, none, block, lambda state: state["blocks"]))

    return F.when(text.rlike(pattern), let(parts, folded)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> dict[str, Column]:
    assign = F.filter(matches(text, ASSIGN, 2), lambda s: F.length(s["value"]) >= 6)
    return {"assign": assign, "access": matches(text, ACCESS), "hex": matches(text, HEX)}


def entropy(value: Column) -> Column:
    """Bits per character."""
    letters = F.split(value, "")
    share = lambda c: F.size(F.filter(letters, lambda x: x == c)) / F.size(letters)
    return F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))


def looks_live(value: Column, least_bits: float, base: bool = False) -> Column:
    """No placeholder, and varied. A bare value needs letters, digits and ``least_bits`` bits a character, as
    a random key has them; a base value, known by its name or form, may be short or of one kind."""
    real = ~value.rlike("(?i)example|sample|placeholder|changeme|xxxx")
    if base:
        return F.when(real, entropy(value) >= VARIED * F.log2(F.length(value))).otherwise(False)
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & real
    return F.when(mixed, entropy(value) >= least_bits).otherwise(False)


def _candidates(spans: Column, least_bits: float, base: bool) -> Column:
    """Each span's value, which ends the span, as ``start``, ``stop``, ``hash`` and whether it ``looks`` live."""
    return F.transform(
        spans,
        lambda s: F.struct(
            (s["stop"] - F.length(s["value"])).alias("start"),
            s["stop"].alias("stop"),
            F.unhex(F.sha2(s["value"], 256)).alias("hash"),
            looks_live(s["value"], least_bits, base).alias("looks"),
        ),
    )


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ORDER)), kind).cast("int")


def _typed(spans: Column, kind: str) -> Column:
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(ORDER.index(kind) + 1).alias("kind"), s["stop"].alias("stop"))
    )


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, ORDER))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"], s["stop"])
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def ownership(candidates: DataFrame) -> DataFrame:
    """Per candidate hash: distinct ``owners`` and ``repositories``, and whether it ``looks`` live.

    Three groupings, each combined before its shuffle, so a value that fills the corpus is never
    counted in one task. A null owner or repository is one unknown owner or repository.
    """
    seen = candidates.groupBy("hash", "owner", "repository").agg(F.max("looks").alias("looks"))
    owned = seen.groupBy("hash", "owner").agg(F.count("*").alias("n"), F.max("looks").alias("looks"))
    return owned.groupBy("hash").agg(
        F.count("*").alias("owners"), F.sum("n").alias("repositories"), F.max("looks").alias("looks")
    )


def scan(
    docs: DataFrame, owner: Column, repository: Column, max_owners: int = 2, max_repositories: int = 4, least_bits: float = 3.0
) -> DataFrame:
    """Secrets in every whole text, one row per row of ``docs``.

    Base spans are those of ``ASSIGN``, ``ACCESS`` and ``HEX``. The corpus adds a span for every base value (of an
    assignment, what is assigned) and bare value (``CANDIDATE``, with a letter and a digit): ``live`` where
    at most ``max_owners`` owners and ``max_repositories`` repositories hold the value and it looks live,
    ``example`` where more hold it. Values leave the
    texts only as hashes. Returns ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``,
    ``base_sha256``, ``spans``, ``n_live`` and ``n_example``. A null or empty text has no spans.
    Repeated rows each get a row.
    """
    text = whole("text")
    base = base_spans(text)
    plain = F.filter(matches(text, CANDIDATE), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    hashed = F.concat(*(_candidates(spans, least_bits, True) for spans in base.values()), _candidates(plain, least_bits, False))
    found = materialize(
        docs.select(
            "doc_id",
            F.xxhash64(text).alias("text_key"),
            owner.alias("owner"),
            repository.alias("repository"),
            *(_typed(spans, kind).alias(kind) for kind, spans in base.items()),
            hashed.alias("candidates"),
        )
    )
    each = found.select("doc_id", "text_key", "owner", "repository", F.inline("candidates"))
    verdicts = ownership(each)
    narrow = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    kind = F.when(~narrow, "example").when(F.col("looks"), "live")
    judged = materialize(verdicts.select("hash", kind.alias("kind")).filter("kind is not null"))
    added = each.select("doc_id", "text_key", "start", "stop", "hash").join(judged, "hash")
    marks = added.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("start", _rank(F.col("kind")).alias("kind"), "stop")).alias("more")
    )
    rows = join_same(found, marks, ["doc_id", "text_key"])
    more = F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,stop:int>>"))
    of_base = F.concat("assign", "access", "hex")
    count = lambda kind: F.size(F.filter(more, lambda s: s["kind"] == ORDER.index(kind) + 1)).cast("long")
    return rows.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in base),
        F.sha2(_joined(of_base), 256).alias("base_sha256"),
        _joined(F.concat(of_base, more)).alias("spans"),
        count("live").alias("n_live"),
        count("example").alias("n_example"),
    )
