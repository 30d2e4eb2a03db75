"""Personal data: high-recall generators, boosted trees over format and context, calibrated thresholds.

The base rules (e-mail, address, card and phone patterns with their checks) always hold.
Beside them looser generators propose spans that may overlap each other. Each proposal is
described by a few whole numbers: its kind, digits, separators, the characters around it
and the cue words before it. Its training label is whether the proposal itself passes the
checks of its kind and no base span of another kind lies across it; neither the checks nor
the marks that only a base pattern asks for are features. So the trees learn where data
that passes stands, and find it where a base pattern ran into its neighbours or asks for
another form. Proposals are counted by description over all documents, a map-side aggregate
with a bounded number of rows, and the trees are boosted on these counts. For each kind the
threshold is the lowest score whose own level keeps ``PRECISION`` on the held-out fold,
levels that contradict the order of the scores being judged together.

Everything is DataFrame code. A span's place is the sum of the lengths before it, which the
same pattern's matches and the gaps between them give within the row.

Defined results: a null or empty text has no spans; places are code points, ends exclusive;
repeated rows get equal results; without proposals nothing is added; an empty table gives
an empty result; the input row can be carried in ``row``, so other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import HELD_OUT, fold, stored

KINDS = ("email", "ip", "card", "phone")
# Possessive loops and the look-behinds only spare the engine retries; the matches are those of the plain patterns.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
PROPOSED = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-][0-9]{4}(?![0-9A-Za-z])",
}
CUES = {
    1: r"(?i)(?:e-?mail|contact|write to)\W*$",
    2: r"(?i)(?:tel|phone|call|fax|mobile)\W*$",
    3: r"(?i)(?:card|visa|account|iban)\W*$",
    4: r"(?i)(?:\bip|host|address|server)\W*$",
    5: r"(?i)(?:id|no|order|version|token|key|password|isbn)\W*$",
}
FEATURES = ("kind", "digits", "separators", "before", "after", "cue")
CONTEXT = 24
PRECISION = 0.8
ROUNDS = 30
RATE = 0.3
RUN = 128


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Compute a column once: a generator stops the optimiser from repeating it inside every use."""
    return df.select("*", F.explode(F.array(value)).alias(name))


_SPAN = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def located(df: DataFrame, name: str, pattern: str, guard: Column) -> DataFrame:
    """Add all matches of a pattern in column ``t`` with their places and surroundings."""
    df = held(df, "_m", F.when(guard, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = held(df, "_g", F.when(F.size("_m") > 0, F.split("t", pattern, -1)).otherwise(F.array().cast("array<string>")))
    df = held(df, "_l", F.zip_with("_m", F.slice("_g", 1, F.size("_m")), lambda m, g: F.length(m) + F.length(g)))
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    # Sums before every RUN-th match keep the work per match bounded.
    df = held(df, "_b", F.transform(F.sequence(F.lit(0), F.floor(F.size("_l") / RUN).cast("int")), lambda b: total(F.slice("_l", 1, b * RUN))))

    def span(m, i):
        run = F.floor(i / RUN).cast("int")
        start = F.get("_b", run) + total(F.slice("_l", run * RUN + 1, i % RUN)) + F.length(F.get("_g", i))
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match"),
                        F.right(F.get("_g", i), F.lit(CONTEXT)).alias("before"), F.left(F.get("_g", i + 1), F.lit(6)).alias("after"))

    return held(df, name, F.transform("_m", span).cast(_SPAN)).drop("_m", "_g", "_l", "_b")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def _luhn(d: Column) -> Column:
    def add(a, i):
        x = F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return a + F.when(x > 9, x - 9).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        octet = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return match.rlike(rf"^{octet}(?:\.{octet}){{3}}$")
    if kind == "card":
        d = _digits(match)
        return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _stands(kind: str, x: Column, cue: Column) -> Column:
    """Whether a proposal passes the checks of its kind, whatever its form; a part of a longer row of short groups is no phone."""
    match = x["match"]
    if kind == "email":
        named = match.rlike(r"[A-Za-z]{2,}$")
        return ~match.rlike(r"[ (\[]") | (named & (match.rlike(r"[(\[]at[)\]]") | (cue == 1)))
    if kind == "card":
        d = _digits(match)
        return F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return _passes(kind, match) & ~x["before"].rlike(r"(?<![0-9.])[0-9]{1,4}[ .-]$") & ~x["after"].rlike(r"^[ .-][0-9]{1,4}(?![0-9.])")
    return _passes(kind, match)


def _described(kind: str, x: Column) -> Column:
    """A proposal with its features."""
    m, before, after = x["match"], x["before"], x["after"]
    edge = lambda c: F.when((c == "") | c.rlike(r"\s"), 0).when(c.rlike(r"[A-Za-z0-9]"), 2).otherwise(1)
    cue = F.lit(0)
    for number, pattern in reversed(CUES.items()):
        cue = F.when(before.rlike(pattern), number).otherwise(cue)
    return F.struct(
        x["start"].alias("start"), x["end"].alias("end"),
        F.lit(KINDS.index(kind)).alias("kind"), F.least(F.length(_digits(m)), F.lit(20)).alias("digits"),
        F.least(F.length(F.regexp_replace(m, r"[^ .-]", "")), F.lit(4)).alias("separators"),
        edge(F.right(before, F.lit(1))).alias("before"), edge(F.left(after, F.lit(1))).alias("after"), cue.alias("cue"),
        _stands(kind, x, cue).alias("stands"))


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def proposals(documents: DataFrame, keep_row: bool = False) -> DataFrame:
    """doc_id, base: spans of the base rules, proposed: described spans with their label ``confirmed``."""
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"),
        *([F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")] if keep_row else []))
    number = F.col("t").rlike("[0-9]")
    at = F.contains("t", F.lit("@"))
    guards = {"email": at, "ip": number, "card": number, "phone": F.contains("t", F.lit("+")) & number}
    loose = {"email": at | F.contains("t", F.lit("(at)")) | F.contains("t", F.lit("[at]")), "ip": number, "card": number, "phone": number}
    for kind in KINDS:
        rows = located(rows, f"base_{kind}", BASE[kind], guards[kind])
        rows = located(rows, f"loose_{kind}", PROPOSED[kind], loose[kind])

    def sure(kind: str) -> Column:
        return F.transform(F.filter(f"base_{kind}", lambda x: _passes(kind, x["match"])),
                           lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind")))

    def likely(kind: str) -> Column:
        return F.transform(f"loose_{kind}", lambda x: _described(kind, x))

    rows = held(rows, "base", F.concat(*map(sure, KINDS)))
    confirmed = lambda x: x["stands"] & ~F.exists("base", lambda b: (b["kind"] != x["kind"]) & _overlap(b, x))
    rows = rows.withColumn("proposed", F.transform(F.concat(*map(likely, KINDS)), lambda x: x.withField("confirmed", confirmed(x).cast("int"))))
    return rows.select("doc_id", *(["row"] if keep_row else []), "base", "proposed")


class Tree:
    """Depth-two regression tree over whole-number features."""

    def __init__(self, rows, gradient, curvature, depth: int = 2, least: float = 1e-6):
        g, h = sum(gradient), sum(curvature)
        self.value, self.split, best = RATE * g / (h + 1.0), None, 1e-9
        if not depth:
            return
        for f in range(len(FEATURES)):
            by: dict[int, list[float]] = {}
            for row, a, b in zip(rows, gradient, curvature, strict=True):
                got = by.setdefault(row[f], [0.0, 0.0])
                got[0] += a
                got[1] += b
            low_g = low_h = 0.0
            for value in sorted(by)[:-1]:
                low_g, low_h = low_g + by[value][0], low_h + by[value][1]
                gain = low_g**2 / (low_h + 1.0) + (g - low_g) ** 2 / (h - low_h + 1.0) - g**2 / (h + 1.0)
                if gain > best and min(low_h, h - low_h) > least:
                    best, self.split = gain, (f, value)
        if self.split:
            f, value = self.split
            sides = [[i for i, row in enumerate(rows) if (row[f] <= value) == low] for low in (True, False)]
            self.low, self.high = (Tree([rows[i] for i in side], [gradient[i] for i in side], [curvature[i] for i in side], depth - 1)
                                   for side in sides)

    def of(self, row) -> float:
        if not self.split:
            return self.value
        return (self.low if row[self.split[0]] <= self.split[1] else self.high).of(row)

    def column(self, x: Column) -> Column:
        if not self.split:
            return F.lit(self.value)
        f, value = self.split
        return F.when(x[FEATURES[f]] <= value, self.low.column(x)).otherwise(self.high.column(x))


class BoostedTrees:
    """Logistic boosting on counts of descriptions; thresholds from counts of the held-out fold."""

    def __init__(self, counts: list[tuple[tuple[int, ...], int, bool, int]], rounds: int = ROUNDS, precision: float = PRECISION):
        fitted: dict[tuple[int, ...], list[float]] = {}
        for row, confirmed, held_out, n in counts:
            if not held_out:
                fitted.setdefault(row, [0.0, 0.0])[confirmed] += n
        rows = sorted(fitted)
        size = {r: sum(fitted[r]) for r in rows}
        positive, total = sum(fitted[r][1] for r in rows), sum(size.values())
        self.start = math.log((positive + 1) / (total - positive + 1))
        score, self.trees = dict.fromkeys(rows, self.start), []
        for _ in range(rounds if rows else 0):
            p = {r: 1 / (1 + math.exp(-score[r])) for r in rows}
            tree = Tree(rows, [fitted[r][1] - size[r] * p[r] for r in rows], [size[r] * p[r] * (1 - p[r]) for r in rows])
            self.trees.append(tree)
            for r in rows:
                score[r] += tree.of(r)
        self.threshold = {}
        for kind in range(len(KINDS)):
            seen = [(self.score(row), confirmed, n) for row, confirmed, held_out, n in counts if held_out and row[0] == kind]
            seen = seen or [(self.score(row), confirmed, n) for row, confirmed, _, n in counts if row[0] == kind]
            by: dict[float, list[int]] = {}
            for value, confirmed, n in seen:
                level = by.setdefault(value, [0, 0])
                level[0] += n * bool(confirmed)
                level[1] += n
            levels: list[tuple[float, int, int]] = []  # lowest score, confirmed, all: shares rise with the score
            for value in sorted(by):
                right, made = by[value]
                while levels and levels[-1][1] * made >= right * levels[-1][2]:
                    value, more_right, more_made = levels.pop()
                    right, made = right + more_right, made + more_made
                levels.append((value, right, made))
            self.threshold[kind] = min((value for value, right, made in levels if right >= precision * made), default=math.inf)

    def score(self, row: tuple[int, ...]) -> float:
        return self.start + sum(t.of(row) for t in self.trees)

    def column(self, x: Column) -> Column:
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + tree.column(x)
        return total

    def selected(self, x: Column) -> Column:
        limit = F.lit(None).cast("double")
        for kind, value in self.threshold.items():
            if value < math.inf:
                limit = F.when(x["kind"] == kind, value - 1e-9).otherwise(limit)
        return F.coalesce(x["score"] >= limit, F.lit(False))


def find(documents: DataFrame, keep_row: bool = False) -> DataFrame:
    """doc_id, base and spans (base and added): arrays of (start, end, kind), by start and kind; ``row`` if asked for."""
    found = stored(proposals(documents, keep_row), "proposals")
    described = found.select(F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), F.explode("proposed").alias("x")).select(
        "held_out", *(F.col(f"x.{f}").alias(f) for f in FEATURES), F.col("x.confirmed").alias("confirmed"))
    # Rows: the product of the features' few values at most.
    counts = described.groupBy("held_out", "confirmed", *FEATURES).count().collect()
    model = BoostedTrees([(tuple(r[f] for f in FEATURES), r["confirmed"], r["held_out"], r["count"]) for r in counts])
    scored = held(found, "scored", F.transform("proposed", lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), model.column(x).alias("score"))))
    free = lambda x: ~F.exists("base", lambda b: _overlap(b, x))
    scored = held(scored, "taken", F.filter("scored", lambda x: model.selected(x) & free(x)))
    better = lambda b, a: (b["score"] > a["score"]) | (
        (b["score"] == a["score"]) & ((b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["kind"] < a["kind"]))))
    added = F.filter("taken", lambda a: ~F.exists("taken", lambda b: _overlap(a, b) & better(b, a)))
    plain = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    return scored.select(
        "doc_id", *(["row"] if keep_row else []), F.array_sort(F.transform("base", plain)).alias("base"),
        F.array_sort(F.transform(F.concat("base", F.transform(added, lambda x: F.struct(x["start"], x["end"], x["kind"]))), plain)).alias("spans"))


def joined(spans: str) -> Column:
    """kind:start:end of all spans, joined by commas."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def counted(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("long")


def redact(documents: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; overlapping spans become one.

    ``n_chars``, where there is one, follows the new text. Null texts stay null.
    """
    found = find(documents, keep_row=True)
    text = F.col("row.text").cast("string")
    name = lambda k: F.element_at(F.array(*(F.lit(f"<{x.upper()}>") for x in KINDS)), k + 1)

    def step(a, x):
        gap = F.when(x["start"] >= a["at"], F.concat(F.substr(text, a["at"] + 1, x["start"] - a["at"]), name(x["kind"]))).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.concat(a["out"], F.array(gap)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    found = held(found, "cut", F.aggregate("spans", start, step))
    new = F.when(F.size("spans") == 0, text).otherwise(F.concat(F.array_join("cut.out", ""), F.substr(text, F.col("cut.at") + 1, F.length(text))))
    found = held(found, "new", new)
    columns = {"text": F.col("new"), "n_chars": F.when(F.size("spans") == 0, F.col("row.n_chars")).otherwise(F.length("new"))
               } if "n_chars" in documents.columns else {"text": F.col("new")}
    types = dict(documents.dtypes)
    return found.select(*(columns.get(c, F.col(f"row.`{c}`")).cast(types[c]).alias(c) for c in documents.columns))
