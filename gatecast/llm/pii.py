"""Personal data: base patterns, and bootstrapped contexts that discover what those miss.

Base spans (email, ip, card, phone) are leftmost and non-overlapping per kind; a match that fails its
check is dropped and not retried. Every search is linear in the text.

Bootstrapping. Base spans are seeds. Every seed, and every other stretch of text that has the shape of
an identifier of some kind (``candidates``), is an instance with up to three lexical patterns: the word
before it, the two words before it, the words on both sides. In rounds Spark scores the bipartite graph
of patterns and instances:
- a pattern's confidence for a kind is the sum of the confidences of its instances of that kind over
  the number of all its distinct instances; it counts from ``LEAST_SEEDS`` distinct instances on that are seeds or as
  sure as ``CONFIDENT`` by then;
- an instance is as sure as the chance that not all of its confident patterns err: 1 - prod(1 - c).
Seeds stay at 1, wherever they stand, candidates start at 0. After ``ROUNDS`` rounds a candidate that is as sure as
``CONFIDENT`` is personal data at all its places. So a number after "call", when what follows
"call" is nearly always a phone number, is found although it has no "+", and so are numbers in contexts that only it made known.

Edges are counted per (pattern, instance) with map-side combine before anything else, joins are on
hashed keys, no pattern's instances are gathered, and the graph is written to the shared folder before the rounds.

Nulls: a null text is empty and has no spans. Ids are carried, not used. Repeated rows each get their
spans; an instance counts once per pattern, however often it is repeated. Ties cannot matter: a score
only meets thresholds. Empty tables give empty results. Extra columns stay in ``mask``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatecast.llm.common import free_name, per_text, quoted
from gatecast.session import materialize

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# The base patterns. A look-behind stands where a search from inside a run could only repeat the run's failure.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Shapes of candidates: numbers in groups, and hexadecimal addresses.
GROUPED = re.compile(r"\(?[0-9][\x20().0-9-]{5,}[0-9]")
COLONS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])")
GROUP = re.compile(r"[^\x20]+")
WORD = re.compile(r"\w+")
ANY = re.compile("[0-9@]")
SPACES = " \t\n\r\x0b\x0c"
TRIM = ".,;:!?()[]{}<>\"'|"

ROUNDS = 3
LEAST_SEEDS = 3
CONFIDENT = 0.8


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: every @ with the run of local characters before it and a domain after it."""
    spans, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            spans.append((start, free))
        else:
            free = max(free, at + 1)
        at = text.find("@", free)
    return spans


def part_fits(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    if not ANY.search(text):
        return []
    spans = [(EMAIL, a, b) for a, b in emails(text)]
    spans += [(IP, *m.span()) for m in ADDRESS.finditer(text) if all(map(part_fits, m[0].split(".")))]
    for match in DIGITS.finditer(text):
        digits = match[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append((CARD, *match.span()))
    spans += [(PHONE, *m.span()) for m in DIALLED.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return spans


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Stretches that look like an identifier and touch no base span; each has one kind. Runs of digits are cut around base spans and into their numbers."""
    starts: list[int] = []  # of the stretches that base spans cover, and their ends
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in taken):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    found: list[tuple[int, int, int]] = []

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)  # only the last stretch that starts before b can reach into a..b
        return k == 0 or ends[k - 1] <= a

    at = text.find("@")
    while at >= 0:  # words with an @ inside
        a, b = at, at
        while a > 0 and text[a - 1] not in SPACES:
            a -= 1
        while b < len(text) and text[b] not in SPACES:
            b += 1
        word = text[a:b]
        a, stop = a + len(word) - len(word.lstrip(TRIM)), a + len(word.rstrip(TRIM))
        if a < at < stop - 1 and free(a, stop):
            found.append((EMAIL, a, stop))
        at = text.find("@", b)
    found += [(IP, *m.span()) for m in COLONS.finditer(text) if free(*m.span())]
    for match in GROUPED.finditer(text):
        at, end = match.span()
        k = bisect_left(ends, at + 1)  # the first stretch that ends behind the run's start
        while at < end:  # the parts of the run between the base spans
            a, b = (starts[k], ends[k]) if k < len(starts) and starts[k] < end else (end, end)
            found += numbers(text, at, min(a, end))
            at, k = max(at, b), k + 1
    return found


def numbers(text: str, start: int, end: int) -> list[tuple[int, int, int]]:
    """The numbers in a run of digits, brackets, dots, hyphens and spaces.

    A group without a space that has seven digits or more is a number, with a bracketed group or one of up to three digits right
    before it. What is left between such numbers is one number if it has 7 to 19 digits; a longer rest is cut from the left into
    numbers of as many groups as make up to eleven digits.
    """
    groups = []  # [start, end, digits], a bracketed group with the one that follows it
    for group in GROUP.finditer(text, start, end):
        digits = sum(map(str.isdigit, group[0]))
        if groups and text[groups[-1][0]] == "(" and text[groups[-1][1] - 1] == ")":
            groups[-1][1:] = [group.end(), groups[-1][2] + digits]
        else:
            groups.append([*group.span(), digits])
    found, loose = [], []

    def flush() -> None:
        total = sum(g[2] for g in loose)
        if total <= 19:
            if loose:
                found.append((loose[0][0], loose[-1][1], total))
        else:
            at = 0
            while at < len(loose):
                to, digits = at + 1, loose[at][2]
                while to < len(loose) and digits + loose[to][2] <= 11:
                    digits += loose[to][2]
                    to += 1
                found.append((loose[at][0], loose[to - 1][1], digits))
                at = to
        loose.clear()

    for group in groups:
        if group[2] >= 7:
            before = loose.pop() if loose and loose[-1][2] <= 3 and loose[-1][2] + group[2] <= 11 and text[group[0]] != "(" else None
            flush()
            found.append((before[0] if before else group[0], group[1], group[2] + (before[2] if before else 0)))
        else:
            loose.append(group)
    flush()
    out = []
    for a, b, digits in found:
        whole = text[a:b].rstrip("(). -")
        shift = len(whole) - len(whole.lstrip(").- "))
        whole, a = whole[shift:], a + shift
        kind = IP if whole.count(".") == 3 and all(whole.split(".")) and whole.replace(".", "").isdigit() else PHONE if digits <= 11 else CARD
        if kind == IP or 7 <= digits <= 19:
            out.append((kind, a, a + len(whole)))
    return out


def letter(c: str) -> bool:
    return c.isalnum() or c == "_"


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical contexts of a stretch of text: the nearest words (letters, digits, underscores), however far, in lower case; the text's ends are words of their own."""
    left, at = [], start
    while at > 0 and len(left) < 2:
        while at > 0 and not letter(text[at - 1]):
            at -= 1
        stop = at
        while at > 0 and letter(text[at - 1]):
            at -= 1
        if stop > at:
            left.append(text[at:stop].lower())
    following = WORD.search(text, end)
    one, two = [*left, "^", "^"][:2]
    after = following[0].lower() if following else "$"
    return [f"{one} _", f"{two} {one} _", f"{one} _ {after}"]


FOUND = (
    "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans array<struct<k:int,s:int,e:int>>,"
    " marks array<struct<k:int,s:int,e:int,seed:boolean,instance:string,patterns:array<string>>>"
)


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def examined(text: str) -> tuple:
    """The values of ``FOUND`` for one text."""
    spans = base_spans(text)
    more = candidates(text, spans) if ANY.search(text) else []
    counts = [sum(k == kind for k, _, _ in spans) for kind in range(4)]
    marks = [
        {"k": k, "s": a, "e": b, "seed": seed, "instance": text[a:b].lower(), "patterns": patterns(text, a, b)}
        for seed, group in ((True, spans), (False, more))
        for k, a, b in group
    ]
    return (*counts, digest(spans), [{"k": k, "s": a, "e": b} for k, a, b in spans], marks)


def found(text: Column) -> Column:
    """A struct of ``FOUND`` for each text."""
    return per_text(examined, FOUND)(text)


def discovered(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(uid, more): spans found by context, from stored rows (uid, marks). Texts without such a span have no row."""
    marks = rows.select("uid", F.explode("marks").alias("m")).select("uid", "m.*")
    seen = marks.select("uid", "k", "s", "e", "seed", F.md5("instance").alias("instance"), F.explode("patterns").alias("pattern"))
    seeds = seen.where("seed").select("k", "instance").distinct().withColumn("known", F.lit(True))
    edges = seen.groupBy("pattern", "k", "instance").agg(F.max("seed").alias("seed"))
    edges = edges.join(seeds, ["k", "instance"], "left").withColumn("seed", F.coalesce("known", "seed")).drop("known")
    # Patterns without any candidate discover nothing; those that fail even if all their instances are sure never count. Most go here.
    kinds = edges.groupBy("pattern", "k").agg(F.count("*").alias("own"), F.sum(F.col("seed").cast("int")).alias("seeds"))
    alive = kinds.join(kinds.groupBy("pattern").agg(F.sum("own").alias("n")), "pattern")
    alive = alive.where((F.col("own") >= LEAST_SEEDS) & (F.col("own") >= CONFIDENT * F.col("n")) & (F.col("own") > F.col("seeds"))).select("pattern", "k", "n")
    graph = materialize(edges.join(alive, ["pattern", "k"]), "pii-graph")
    # Each round reads the stored graph and the round before once, so all rounds are one plan.
    least = CONFIDENT - 1e-9  # the logarithms below round
    found, sure = None, graph.withColumn("sure", F.col("seed").cast("double"))
    for _ in range(rounds):
        believed = sure.groupBy("pattern", "k").agg((F.sum("sure") / F.max("n")).alias("confidence"), F.sum((F.col("sure") >= least).cast("int")).alias("certain"))
        strong = believed.where((F.col("confidence") >= CONFIDENT) & (F.col("certain") >= LEAST_SEEDS)).select("pattern", "k", "confidence")
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
        found = graph.where("NOT seed").join(strong, ["pattern", "k"]).groupBy("k", "instance").agg((1 - doubt).alias("found"))
        belief = F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("found", F.lit(0.0)))
        sure = graph.join(found, ["k", "instance"], "left").withColumn("sure", belief)
    known = seeds.select("k", "instance").unionByName(found.where(F.col("found") >= least).select("k", "instance"))
    places = marks.where("NOT seed").select("uid", "k", "s", "e", F.md5("instance").alias("instance"))
    new = places.join(known, ["k", "instance"], "left_semi").select("uid", "k", "s", "e").distinct()
    # One row per text with a find; a text's own spans only.
    return new.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("k", "s", "e"))).alias("more"))


def span_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined, by kind, then start."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"], x["e"])), ",")


def all_spans(rows: DataFrame) -> DataFrame:
    """Stored rows (uid, spans, marks, …) with the spans that contexts added; only texts with candidates are joined."""
    more = discovered(rows)
    with_candidates = F.exists("marks", lambda m: ~m["seed"])
    empty = F.array().cast("array<struct<k:int,s:int,e:int>>")
    plain = rows.where(~with_candidates).withColumn("more", empty)
    joined = rows.where(with_candidates).join(more, "uid", "left").withColumn("more", F.coalesce("more", empty))
    return plain.unionByName(joined)


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts and digest of the base spans, all spans, and how many contexts added."""
    rows = docs.select("doc_id", found(F.col("text")).alias("f")).select("doc_id", "f.*", F.monotonically_increasing_id().alias("uid"))
    done = all_spans(materialize(rows, "pii-rows"))
    spans = span_text(F.concat("spans", "more"))
    return done.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("spans"), F.size("more").cast("long").alias("n_added"))


def masked(text: str, spans: list) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, free = [], 0
    for a, b, k in sorted((x["s"], x["e"], x["k"]) for x in spans):
        if a >= free:
            out += [text[free:a], f"<{KINDS[k].upper()}>"]
        free = max(free, b)
    return "".join([*out, text[free:]])


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with all personal data in ``text`` masked; same rows and columns, a null text stays null."""
    taken = [free_name(docs.columns, "pii_found"), free_name(docs.columns, "pii_uid")]
    stored = materialize(docs.withColumn(taken[0], found(F.col("text"))).withColumn(taken[1], F.monotonically_increasing_id()), "pii-docs")
    # Columns of any name may be in docs, so they travel in one struct.
    rows = stored.select(F.col(taken[1]).alias("uid"), F.col(f"{taken[0]}.spans"), F.col(f"{taken[0]}.marks"), F.struct(*map(quoted, docs.columns)).alias("row"))
    done = all_spans(rows)

    def apply(texts: pd.Series, spans: pd.Series, more: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not (len(s) or len(m)) else masked(t, [*s, *m]) for t, s, m in zip(texts, spans, more)])

    apply.__annotations__ = {"texts": pd.Series, "spans": pd.Series, "more": pd.Series, "return": pd.Series}
    clean = F.pandas_udf(apply, "string")(F.col("row.text"), F.col("spans"), F.col("more"))
    return done.select(clean.alias("clean"), "row").select(*[F.col("clean").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
