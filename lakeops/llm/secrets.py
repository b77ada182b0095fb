"""Secrets in texts: fixed patterns, and weak parts that count only next to complementary parts.

Column expressions and joins only. Matches are marked in the text, the text is split at the marks, and the
running lengths of the pieces are the code-point positions. Parts of a credential are identifiers, secrets
and endpoints; a weak candidate is reported only when parts of the other kinds lie within the same scope,
found by an interval join on document and scope cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.llm.shared import handover

MARK, STAND_IN = "\x01", "\x02"
SCOPE = 200  # code points between the starts of parts that belong together

# The base patterns and the least lengths of their matches, in the order of the kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the whole run, 18 or more characters
HEX = r"[0-9a-f]{16,}"
BASE = ("assign", "access", "hex")

# Weak candidates: what each kind looks like, and whether it is an identifier, a secret or an endpoint. A key
# may follow '=' or ':' at once and is a whole run of any length.
WEAK = (
    ("id", "identifier", r"(?i:\b(?:user(?:name)?|login|client_?id|account|\w*access_?key_?id)\b)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}|\b(?:AKIA|ASIA)[A-Z0-9]{4,}\b"),
    ("key", "secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"),
    ("endpoint", "endpoint", r"\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/@%-]+|\barn:[a-z0-9-]+:[a-z0-9-]+:[A-Za-z0-9:/_.-]+"),
)
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret"} | {kind: role for kind, role, _ in WEAK}
ORDER = {kind: i for i, kind in enumerate((*BASE, *(kind for kind, _, _ in WEAK)))}
SPAN = "struct<start: int, rank: int, stop: int, kind: string>"


def spans(text: Column, pattern: str, kind: str) -> Column:
    """Array of (start, rank, stop, kind) of the leftmost non-overlapping matches; code points, stop
    exclusive. Texts without a match are not rewritten."""
    plain = F.translate(text, MARK, STAND_IN)
    parts = F.split(F.regexp_replace(plain, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(f"array<{SPAN}>").alias("found"))

    def step(state: Column, part: Column) -> Column:
        stop = state["at"] + F.char_length(part)
        span = F.struct(state["at"].alias("start"), F.lit(ORDER[kind]).alias("rank"), stop.alias("stop"), F.lit(kind).alias("kind"))
        found = F.when(state["i"] % 2 == 1, F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct(stop.alias("at"), (state["i"] + 1).alias("i"), found.alias("found"))

    return F.when(plain.rlike(pattern), F.aggregate(parts, start, step, lambda s: s["found"])).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each base kind; matches with too short a value are dropped after matching."""
    assigned = F.filter(
        spans(text, ASSIGN, "assign"),
        lambda s: F.char_length(F.regexp_extract(F.substring(text, s["start"] + 1, s["stop"] - s["start"]), ASSIGN, 1)) >= ASSIGN_LEAST,
    )
    return {"assign": assigned, "access": spans(text, ACCESS, "access"), "hex": spans(text, HEX, "hex")}


def listed(found: Column) -> Column:
    """kind:start:stop by start, then kind, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(F.array_sort(found), one), ",")


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def find_parts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, key, base, n_assign, n_access, n_hex, weak) of every row; ``key`` names the row's content."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    found = base_spans(F.col("text"))
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text"))
    rows = rows.select("id", F.sha2("text", 256).alias("key"), "text", *(v.alias(k) for k, v in found.items()))
    weak = F.concat(*(spans(F.col("text"), pattern, kind) for kind, _, pattern in WEAK))
    rows = rows.select(
        "id", "key", F.concat(*BASE).alias("base"), *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), weak.alias("weak")
    )
    return rows.withColumn("weak", F.filter("weak", lambda w: ~F.exists("base", lambda b: _overlaps(w, b))))


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(key, linked): per distinct content the weak spans that complementary parts stand near to.

    An identifier needs a secret within the scope, a secret needs an identifier or an endpoint, an
    endpoint needs both. Parts meet in cells of ``scope`` code points: each part looks into its own cell
    and both neighbours, where only the nearest start before and after matters to each role, so a cell is
    folded to its first and last start per role and no pair of parts is formed.
    """
    role = F.element_at(F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair)), F.col("span.kind"))
    distinct = parts.filter(F.size("weak") > 0).groupBy("key").agg(F.first("base").alias("base"), F.first("weak").alias("weak"))
    all_parts = distinct.select("key", F.explode(F.concat("base", "weak")).alias("span")).select(
        "key", "span", role.alias("role"), F.floor(F.col("span.start") / scope).cast("long").alias("cell")
    )
    spread = all_parts.select("key", "role", F.col("span.start").alias("start"), F.explode(F.array(*(F.col("cell") + d for d in (-1, 0, 1)))).alias("cell"))
    starts = spread.groupBy("key", "cell").agg(
        *(F.sort_array(F.collect_set(F.when(F.col("role") == r, F.col("start")))).alias(r) for r in ("identifier", "secret", "endpoint"))
    )
    weak = all_parts.filter(F.col("span.rank") >= len(BASE))
    near = weak.join(starts, ["key", "cell"])
    within = lambda r: F.exists(r, lambda s: F.abs(s - F.col("span.start")) <= scope)
    complete = (
        F.when(F.col("role") == "identifier", within("secret"))
        .when(F.col("role") == "secret", within("identifier") | within("endpoint"))
        .otherwise(within("identifier") & within("secret"))
    )
    return near.filter(complete).groupBy("key").agg(F.collect_set("span").alias("linked"))


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base, spans) of every row: the base spans, and those together with
    the linked weak ones, as arrays of (start, rank, stop, kind).

    Null texts are empty; empty texts have no spans. Rows repeat as in the input and null ids stay: links
    are found per distinct content, so equal texts get equal spans. Any length of text works.
    """
    parts = handover(find_parts(docs, id_column, text_column), "parts")
    linked = handover(link_parts(parts, scope), "linked")
    joined = parts.join(linked, "key", "left")
    everything = F.concat("base", F.coalesce("linked", F.array().cast(f"array<{SPAN}>")))
    return joined.select(
        F.col("id").alias(id_column), "n_assign", "n_access", "n_hex", F.array_sort("base").alias("base"), F.array_sort(everything).alias("spans")
    )


def redact(text: Column, found: Column, by: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones as one, replaced."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        fresh = span["start"] >= state["at"]
        return F.struct(
            F.when(fresh, F.concat(state["out"], gap, F.lit(by))).otherwise(state["out"]).alias("out"),
            F.greatest(state["at"], span["stop"]).alias("at"),
        )

    done = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text)))
    return F.aggregate(F.array_sort(found), start, step, done)
