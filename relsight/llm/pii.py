"""Personal data by boosted candidates, in DataFrame expressions only.

The base rules (email, ip, card, phone) always hold. High-recall generators
propose further, overlapping candidate spans; binned format and context
features of each are scored by gradient-boosted trees, and a threshold that
is calibrated for each generator selects the spans to add. Training counts
feature patterns over all documents, at every size. Its labels are weak, one
rule a generator: a secret's value or a digest mixes letters, of any case,
and digits; an address has the groups of a hardware or IPv6 address; a handle
has a name at a host without a dot; a number of a phone's length follows a
cue; and a candidate that holds a value of a base rule is positive too. Texts
fall into two folds, and each fold's trees score the other fold's texts, in
calibration and in use, so a threshold holds for the scores it was made from.
A secret's threshold keeps every positive one. The trees are small Python
code over the pattern counts and become one Column expression.

Defined cases: null and empty texts have no spans; spans are code points,
end exclusive; base spans may overlap each other, secrets may hold base
spans, and other added spans overlap nothing; repeated rows are treated
alike; a null doc_id stays null; an empty table trains no trees, adds nothing
and gives no rows; other columns are carried, but for one named as the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds in their order. A repeated group is possessive, as nothing after it
# could use what it gives back; a start inside a run of local-part characters can't match if the run's start didn't.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]
# The generators of candidates, and the kind that an added span of each has. Runs are
# possessive and have no upper bound, so that no long value is cut.
GENERATORS = {
    "handle": r"(?:\G|(?<![^\s@]))[^\s@]++@[^\s@]++",
    "address": r"[0-9A-Fa-f]{1,4}(?:[.:][0-9A-Fa-f]{1,4}){3,7}",
    "number": r"[+(]?[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+",
    "secret": r"(?i:password|passwd|pwd|token|secret|api[_-]?key)\x20{0,2}[=:]\x20{0,2}[\"']?[^\s\"']{6,}+[\"']?",
    "digest": r"\b[0-9a-f]{16,}+\b",
}
ADDED = list(GENERATORS)
#: The precision that a threshold must reach.
PRECISION = 0.95
SPAN = "struct<kind:int,start:int,end:int,match:string,before:string,after:string>"
#: Matches whose offsets are summed at a time.
CHUNK = 128


def spans(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<kind,start,end,match,before,after>>: leftmost non-overlapping matches with their code-point offsets.

    before and after are the text up to the neighbouring matches. Offsets are summed a chunk of
    matches at a time, so the work grows with the matches, not with their square.
    """
    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))

    def step(s: Column, p: Column) -> Column:
        start = s["at"] + F.length(p["before"])
        end = start + F.length(p["match"])
        one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), p["match"].alias("match"), p["before"].alias("before"), p["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(s["found"], F.array(one)).alias("found"))

    def chunked(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / CHUNK).cast("int")), lambda c: F.aggregate(F.slice(parts, c * CHUNK + 1, F.lit(CHUNK)), none, step))

    def summed(chunks: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(chunks, zero, lambda s, c: F.struct((s["at"] + c["at"]).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")))["starts"]
        moved = F.zip_with(chunks, starts, lambda c, at: F.transform(c["found"], lambda x: x.withField("start", x["start"] + at).withField("end", x["end"] + at)))
        return F.flatten(moved)

    def parted(both: Column) -> Column:
        gaps, matches = both["gaps"], both["matches"]
        n = F.size(matches)
        return F.arrays_zip(F.slice(gaps, 1, n).alias("before"), matches.alias("match"), F.slice(gaps, 2, n).alias("after"))

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))
    found = let(let(let(both, parted), chunked), summed)
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), F.lit(0), add) % 10 == 0


def is_card(match: Column) -> Column:
    n = digits(match)
    return F.when(F.length(n).between(14, 19), luhn(n)).otherwise(F.lit(False))


def is_ip(match: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+(?=.)", "")
        return F.when(F.length(bare) <= 3, bare.cast("int") <= 255).otherwise(F.lit(False))

    return F.forall(F.split(match, r"\."), small)


def base_spans(text: Column) -> Column:
    """The base rules' spans by start, then kind."""
    has = lambda what, found: F.when(F.contains(text, F.lit(what)), found).otherwise(F.array().cast(f"array<{SPAN}>"))
    email = has("@", spans(text, EMAIL, 0))
    ip = has(".", F.filter(spans(text, IP, 1), lambda s: is_ip(s["match"])))
    card = F.filter(spans(text, CARD, 2), lambda s: is_card(s["match"]))
    phone = has("+", F.filter(spans(text, PHONE, 3), lambda s: F.length(digits(s["match"])).between(10, 15)))
    return F.array_sort(F.transform(F.concat(email, ip, card, phone), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))


def binned(value: Column, edges: list[int]) -> Column:
    return sum(((value >= e).cast("int") for e in edges), F.lit(0))


# The features: name and the number of bins of each.
FEATURES = {"gen": 5, "size": 5, "numerals": 6, "plus": 2, "at": 2, "dots": 4, "colons": 4, "pairs": 2, "letters": 2, "upper": 2, "mixed": 2, "checked": 2, "cue": 2, "open": 2, "shut": 2}
#: Words before a number that make it a phone's.
CUE = r"(?i)\b(?:phone|tel|mobile|call|fax)\b\S{0,2}\s{0,2}\S{0,2}$"


def candidates(text: Column, labels: bool = False) -> Column:
    """array<struct<kind,start,end,f>>: all generators' spans with their feature bins; y: whether it is positive, if asked for."""
    found = []
    for i, (name, pattern) in enumerate(GENERATORS.items()):
        cheap = {"handle": F.contains(text, F.lit("@")), "secret": F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))}.get(name, F.lit(True))
        found.append(F.when(cheap, spans(text, pattern, i)).otherwise(F.array().cast(f"array<{SPAN}>")))

    def one(x: Column) -> Column:
        s, n = x["s"], x["n"]
        m = s["match"]
        before, after = s["before"], s["after"]
        of = lambda name: s["kind"] == ADDED.index(name)
        # What follows a secret's cue; else the whole match.
        value = F.when(of("secret"), F.regexp_replace(m, r"^[^=:]*[=:]", "")).otherwise(m)
        letters = F.regexp_like(value, F.lit("[A-Za-z]"))
        mixed = letters & F.regexp_like(value, F.lit("[0-9]"))
        called = F.regexp_like(F.right(before, F.lit(16)), F.lit(CUE))
        pairs = F.regexp_like(m, F.lit("^[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}$"))
        colons = F.size(F.split(m, ":")) - 1
        values = [
            s["kind"],
            binned(F.length(m), [10, 15, 20, 32]),
            binned(n, [1, 7, 10, 14, 20]),
            F.contains(m, F.lit("+")).cast("int"),
            F.contains(m, F.lit("@")).cast("int"),
            binned(F.size(F.split(m, r"\.")) - 1, [1, 3, 4]),
            binned(colons, [1, 5, 7]),
            pairs.cast("int"),
            letters.cast("int"),
            F.regexp_like(value, F.lit("[A-Z]")).cast("int"),
            mixed.cast("int"),
            F.when(n.between(14, 19), luhn(digits(m))).otherwise(F.lit(False)).cast("int"),
            called.cast("int"),
            F.regexp_like(before, F.lit(r"^$|[\s\"'(]$")).cast("int"),
            # A quote that the match ends with closes it, whatever follows.
            (F.regexp_like(m, F.lit("[\"']$")) | F.regexp_like(after, F.lit(r"^(?:$|[\s\"').,;])"))).cast("int"),
        ]
        own = (of("secret") & mixed) | (of("digest") & mixed & (F.length(m) >= 32)) | (of("address") & ((colons == 7) | pairs))
        own |= (of("handle") & F.regexp_like(m, F.lit(r"^[A-Za-z0-9._%+-]+@[A-Za-z][A-Za-z0-9-]*$"))) | (of("number") & called & n.between(7, 15))
        # A value that a base rule accepts.
        sure = F.regexp_like(m, F.lit(EMAIL)) | (F.regexp_like(m, F.lit(f"^{IP}$")) & is_ip(m)) | is_card(m) | (F.regexp_like(m, F.lit(f"^{PHONE}$")) & n.between(10, 15))
        f = F.struct(*[v.alias(f) for v, f in zip(values, FEATURES, strict=True)])
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), f.alias("f"), *([(own | sure).alias("y")] if labels else []))

    return F.transform(F.transform(F.concat(*found), lambda s: F.struct(s.alias("s"), F.length(digits(s["match"])).alias("n"))), one)


def settled(fixed: Column, chosen: Column) -> Column:
    """The chosen spans that overlap no fixed one and no earlier chosen one, in one pass over both by start."""
    span = "struct<start:int,kind:int,end:int>"
    item = lambda x, own: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["kind"].alias("kind"), x["end"].alias("end"))
    rows = F.array_sort(F.concat(F.transform(fixed, lambda x: item(x, 0)), F.transform(chosen, lambda x: item(x, 1))))
    # end: of all fixed spans so far; open: the last chosen span, until nothing that begins later can meet it.
    none = F.struct(F.lit(0).alias("end"), F.lit(None).cast(span).alias("open"), F.array().cast(f"array<{span}>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        meets = s["open"].isNotNull() & (x["start"] < s["open"]["end"])
        out = F.when(s["open"].isNull() | meets, s["out"]).otherwise(F.concat(s["out"], F.array(s["open"])))
        new = F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
        fixed_step = F.struct(F.greatest(s["end"], x["end"]).alias("end"), F.lit(None).cast(span).alias("open"), out.alias("out"))
        blocked = meets | (x["start"] < s["end"])
        chosen_step = F.when(blocked, s).otherwise(F.struct(s["end"].alias("end"), new.alias("open"), out.alias("out")))
        return F.when(x["own"] == 0, fixed_step).otherwise(chosen_step)

    return F.aggregate(rows, none, step, lambda s: F.when(s["open"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["open"]))))


def boost(patterns: list[tuple[tuple[int, ...], float, float]], rounds: int = 20, rate: float = 0.4) -> tuple[float, list]:
    """Boosted trees of depth 2 over (bins, positives, negatives): the first log odds, and trees of nested tests."""
    pos, neg = sum(p for _, p, _ in patterns), sum(n for _, _, n in patterns)
    start = math.log((pos + 1) / (neg + 1))
    score = [start] * len(patterns)
    tests = [(f, b) for f, bins in enumerate(FEATURES.values()) for b in range(1, bins)]

    def gain(rows: list[int], g: list[float], h: list[float]) -> float:
        return sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + 1)

    def best(rows: list[int], g: list[float], h: list[float]):
        top = (1e-9, None)
        for f, b in tests:
            yes = [i for i in rows if patterns[i][0][f] >= b]
            if yes and len(yes) < len(rows):
                no = [i for i in rows if patterns[i][0][f] < b]
                top = max(top, (gain(yes, g, h) + gain(no, g, h) - gain(rows, g, h), (f, b, yes, no)), key=lambda x: x[0])
        return top[1]

    trees = []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g = [a - (a + b) * q for (_, a, b), q in zip(patterns, p, strict=True)]
        h = [(a + b) * q * (1 - q) for (_, a, b), q in zip(patterns, p, strict=True)]

        def grow(rows: list[int], depth: int, g=g, h=h):
            split = best(rows, g, h) if depth else None
            if not split:
                value = rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1)
                for i in rows:
                    score[i] += value
                return value
            f, b, yes, no = split
            return (f, b, grow(yes, depth - 1), grow(no, depth - 1))

        trees.append(grow(list(range(len(patterns))), 2))
    return start, trees


def leaf(tree, bins: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if bins[tree[0]] >= tree[1] else tree[3]
    return tree


def selected(model: dict, fold: Column, kind: Column, f: Column) -> Column:
    """Whether a candidate's score, by the trees of the other fold, reaches the threshold of its generator."""
    names = list(FEATURES)

    def column(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(f[names[tree[0]]] >= tree[1], column(tree[2])).otherwise(column(tree[3]))

    first, second = (sum((column(t) for t in trees), F.lit(float(start))) for start, trees in model["grown"])
    limit = F.lit(float("inf"))
    for g, t in model["limits"].items():
        limit = F.when(kind == g, F.lit(float(t))).otherwise(limit)
    return F.when(fold == 1, first).otherwise(second) >= limit


def fold_of(text: Column) -> Column:
    return F.pmod(F.xxhash64(text, F.lit(5)), F.lit(2)).cast("int")


def fit(docs: DataFrame, precision: float = PRECISION) -> dict:
    """Count feature patterns over all documents, boost trees on each fold, and calibrate thresholds on the scores of the other fold."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(text.alias("text")).select(fold_of(F.col("text")).alias("fold"), candidates(F.col("text"), True).alias("c"))
    rows = rows.select("fold", F.explode("c").alias("c"))
    counts = rows.groupBy("fold", *[F.col(f"c.f.{f}") for f in FEATURES]).agg(F.count_if("c.y").alias("p"), F.count_if(~F.col("c.y")).alias("n")).collect()
    folds = [sorted((tuple(r[f] for f in FEATURES), float(r.p), float(r.n)) for r in counts if r.fold == k) for k in (0, 1)]
    # A fold without patterns has no trees, and the other one's are for both.
    some = [boost(patterns) for patterns in folds if patterns] or [(0.0, [])]
    grown = [some.pop(0) if patterns and len(some) > 1 else some[0] for patterns in folds]
    scored = [(grown[1 - k][0] + sum(leaf(t, bins) for t in grown[1 - k][1]), bins[0], p, n) for k in (0, 1) for bins, p, n in folds[k]]
    limits = {}
    for g in range(len(ADDED)):
        p = n = 0.0
        own = sorted((x for x in scored if x[1] == g), reverse=True)
        for s, _, a, b in own:
            p, n = p + a, n + b
            if p >= precision * (p + n):
                limits[g] = s - 1e-9
        lowest = min((s for s, _, a, _ in own if a), default=None)
        if g == ADDED.index("secret") and lowest is not None:
            limits[g] = min(limits.get(g, lowest), lowest - 1e-9)
    return {"grown": grown, "limits": limits}


def find(docs: DataFrame, model: dict, into: str = "pii") -> DataFrame:
    """The columns of ``docs`` and the struct ``into`` (in place of a column of that name).

    Its fields are base and all, both array<struct<start,kind,end>>; added kinds count from 4.
    Secrets are added whole, even around a base span; other added spans overlap nothing.
    """
    row = F.struct(*docs.columns).alias("row")
    rows = docs.select(row, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    rows = rows.select("row", fold_of(F.col("t")).alias("fold"), base_spans(F.col("t")).alias("base"), candidates(F.col("t")).alias("c"))
    picked = F.transform(F.filter("c", lambda c: selected(model, F.col("fold"), c["kind"], c["f"])), lambda c: F.struct(c["start"].alias("start"), (c["kind"] + len(KINDS)).alias("kind"), c["end"].alias("end")))
    rows = rows.select("row", "base", picked.alias("c"))
    secret = len(KINDS) + ADDED.index("secret")
    secrets, others = F.filter("c", lambda c: c["kind"] == secret), F.filter("c", lambda c: c["kind"] != secret)
    rows = rows.select("row", "base", secrets.alias("s"), others.alias("o")).select("row", "base", "s", settled(F.concat("base", "s"), F.col("o")).alias("o"))
    found = F.struct("base", F.array_sort(F.concat("base", "s", "o")).alias("all")).alias(into)
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() != into.lower()], found)


def named(found: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in [*KINDS, *ADDED]])
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def redact(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become the first one's.

    The text is cut into code points once, so the work grows with its length and its spans.
    """
    names = F.array(*[F.lit(k.upper()) for k in [*KINDS, *ADDED]])
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int,kind:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        new = F.concat(s["out"], F.array(F.struct(s["at"].alias("from"), x["start"].alias("to"), x["kind"].alias("kind"))))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], new).otherwise(s["out"]).alias("out"))

    def joined(s: Column) -> Column:
        chars = F.split(text, "", -1)
        cut = lambda a, n: F.array_join(F.slice(chars, a + 1, n), "")
        last = cut(s["at"], F.greatest(F.length(text) - s["at"], F.lit(0)))
        return F.concat(F.array_join(F.transform(s["out"], lambda x: F.concat(cut(x["from"], x["to"] - x["from"]), F.lit("["), F.get(names, x["kind"]), F.lit("]"))), ""), last)

    return F.aggregate(found, none, step, joined)
