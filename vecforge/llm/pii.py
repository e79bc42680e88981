"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Generators propose spans: strict patterns for email, ip, card and phone, and wide ones (spelt-out addresses, IPv6, other
separators, numbers without +) that may overlap them. Boosted trees over format and context features score the wide
ones; a threshold for each kind, calibrated on rows that no tree saw, selects those that are redacted too. Strict matches
that pass their checks always stay.

Trees are fitted on the driver from examples whose truth is known: strict matches of a bounded sample of documents (and
made-up ones beside them) rewritten into the forms that only the wide patterns find, in the contexts that they had, and
look-alikes that are none (dates, years, versions, times, order numbers, round numbers) between other words of the sample.
They become CASE expressions, so that no Python runs on the executors.

Places are counted in code points, from the lengths of the pieces between the matches. Candidates are exploded and
numbered by windows over their own row, whose frames all grow from one end: a document costs what its length and the
sorting of its matches do.

Defined cases: a null text is empty and has no spans. Rows that repeat an id each give a row. Columns other than doc_id
and text are not read by find(); redact() keeps them all. A document sample without strict matches leaves the made-up
ones to learn from.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, thinned

KINDS = ("email", "ip", "card", "phone")
#: Strict patterns. Possessive repeats and look-behinds only spare backtracking; they match what the plain forms do.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Patterns of high recall.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{1,63}){1,6}",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]?[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![.-]?[0-9])",
}
#: What a text must contain for a pattern to match, and patterns that it must match first.
NEEDS = {("email", True): "@", ("phone", True): "+"}
HINTS = {("email", False): r"[(\[{]at[)\]}]", ("ip", False): r"[0-9A-Fa-f]?:[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]"}
#: Words before a span that speak for its kind.
CUES = {"email": r"(?i)(e-?mail|contact|write)", "ip": r"(?i)\b(ip|host|addr\w*|server)\b", "card": r"(?i)(card|visa|master|credit|amex)", "phone": r"(?i)(tel|phone|call|mobile|fax)"}
#: Words before a span that speak for something else.
OTHER = r"(?i)(order|invoice|item|part|ref\w*|isbn|issn|version|build|pages?|no|nr|id|serial|code|case|years?|size|score|at|from|total)[\s.:#]*$"
#: Code points of context kept on either side.
LEFT, RIGHT = 24, 4
#: Bounds of the training sample in documents and in examples of a kind and truth; trees, their learning rate, and candidate thresholds of a feature.
SAMPLE_DOCUMENTS, EXAMPLES, ROUNDS, RATE, THRESHOLDS = 25_000, 500, 40, 0.3, 12
#: Precision that a kind's threshold must reach on the calibration rows.
PRECISION = 0.99


def proposals(text: Column, kind: str, strict: bool) -> Column:
    """Array of candidates: kind, strict, number, length of the piece before, contexts, the match."""
    pattern = (STRICT if strict else WIDE)[kind]
    element = F.struct(
        F.lit(kind).alias("kind"),
        F.lit(strict).alias("strict"),
    )
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(
        F.transform(pieces, lambda p: F.struct(F.char_length(p).cast("long").alias("gap"), F.right(p, F.lit(LEFT)).alias("before"), F.left(p, F.lit(RIGHT)).alias("start"))),
        found,
        lambda p, m: F.struct(element["kind"].alias("kind"), element["strict"].alias("strict"), p["gap"].alias("gap"), p["before"].alias("before"), p["start"].alias("start"), m.alias("match")),
    )
    need, hint = NEEDS.get((kind, strict)), HINTS.get((kind, strict), r"[0-9]{2}|[0-9][ ._/()-]")
    return F.when(F.contains(text, F.lit(need)) if need else F.rlike(text, F.lit(hint)), both)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a number's check digit is right."""
    parts = F.transform(F.split(F.reverse(number), "(?!$)"), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(parts, F.lit(0), lambda a, b: a + b) % 10 == 0


def candidates(documents: DataFrame) -> DataFrame:
    """A row for each candidate, and one without a kind for each document.

    row is a number of the document's row in this scan; first and last are code points, the end exclusive.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    arrays = [F.coalesce(proposals(F.col("_text"), k, s), F.expr("cast(array() as array<struct<kind: string, strict: boolean, gap: bigint, before: string, start: string, match: string>>)")) for s in (True, False) for k in KINDS]
    rows = documents.select("doc_id", text.alias("_text")).withColumn("row", F.monotonically_increasing_id())
    # Each document has one element without a kind, so that none is lost.
    nobody = F.expr("named_struct('kind', cast(null as string), 'strict', false, 'gap', 0L, 'before', '', 'start', '', 'match', cast(null as string), 'number', 0)")
    numbered = [F.transform(a, lambda x, i: x.withField("number", i)) for a in arrays]
    each = rows.select("doc_id", F.xxhash64("doc_id", "_text", F.isnull("doc_id")).alias("k2"), "row", F.explode(F.concat(F.array(nobody), *numbered)).alias("x")).select("doc_id", "k2", "row", "x.*")
    # The last piece has no match; its start is the context after the match before it.
    w = Window.partitionBy("row", "kind", "strict").orderBy("number")
    size = F.col("gap") + F.coalesce(F.char_length("match"), F.lit(0))
    placed = each.withColumns({"last": F.sum(size).over(w), "after": F.lead("start").over(w)})
    placed = placed.where("match is not null or kind is null")
    return placed.select("doc_id", "k2", "row", "kind", "strict", "before", "match", F.coalesce("after", F.lit("")).alias("after"), (F.col("last") - F.char_length("match")).alias("first"), "last")


def judged(found: DataFrame) -> DataFrame:
    """Candidates with features f0, f1, ... and whether they are strictly valid."""
    m, kind, d = F.col("match"), F.col("kind"), digits(F.col("match"))
    n = F.char_length(d)
    octets = F.rlike(m, F.lit(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"))
    check = F.when((n >= 12) & (n <= 19), luhn(d)).otherwise(F.lit(False))
    passes = F.when(kind == "email", True).when(kind == "ip", octets).when(kind == "card", check).when(kind == "phone", (n >= 9) & (n <= 15))
    cue = F.lit(False)
    for k in KINDS:
        cue = F.when(kind == k, F.rlike("before", F.lit(CUES[k]))).otherwise(cue)
    features = [
        n,
        F.char_length(m),
        F.char_length(F.regexp_replace(m, r"[^\x20._/()-]", "")),
        check,
        octets,
        F.array_max(F.transform(F.split(F.left(m, F.lit(80)), r"[^0-9]+"), lambda x: F.char_length(x))),
        F.size(F.array_distinct(F.split(F.left(d, F.lit(40)), ""))),
        cue,
        F.rlike("before", F.lit(r"(^|[\s,;:(\[\"'])$")),
        F.rlike("after", F.lit(r"^($|[\s,;:.)\]\"'])")),
        F.char_length(F.regexp_replace(m, r"[^A-Za-z]", "")) / F.char_length(m),
        F.char_length(F.regexp_replace(m, r"[^.]", "")),
        F.rlike(m, F.lit(r"^(\+|00)")),
        F.rlike(m, F.lit(r"@|[(\[{]at[)\]}]")),
        F.rlike(m, F.lit(r"^[12][0-9]{3}[-./ ][0-9]{2}[-./ ][0-9]{2}")),
        F.rlike("before", F.lit(OTHER)),
        F.rlike(m, F.lit(r"^\(?(19|20)[0-9]{2}\)?[^0-9]")),
        F.char_length(F.regexp_replace(m, r"[^0-9]*[0-9]*?(0{2,})(?![0-9])|.", "$1")),
        F.rlike(m, F.lit(r"[(\[{]dot[)\]}]")),
        F.rlike(m, F.lit(r"[.] ")),
        F.char_length(F.regexp_replace(m, r"[^:]", "")),
        F.contains(m, F.lit("::")),
        F.rlike(m, F.lit(r"[A-Fa-f]")),
        F.char_length(F.regexp_extract(m, r"([A-Za-z]*)$", 1)),
        F.startswith(m, F.lit("(")),
        F.size(F.array_distinct(F.split(F.regexp_replace(m, r"[A-Za-z0-9()]", ""), ""))),
        F.char_length(F.regexp_extract(m, r"([0-9]*)$", 1)),
        F.char_length(F.regexp_extract(m, r"^\(?([0-9]*)", 1)),
        *(kind == k for k in KINDS),
    ]
    cols = {f"f{i}": F.coalesce(f.cast("double"), F.lit(0.0)) for i, f in enumerate(features)}
    return found.withColumns({"valid": F.coalesce(F.col("strict") & passes, F.lit(False)), **cols})


FEATURES = 32


class Trees:
    """Gradient boosting with trees of two levels, a Platt calibration, and a threshold for each kind."""

    def __init__(self, x: np.ndarray, y: np.ndarray, kind: np.ndarray) -> None:
        self.trees: list[tuple] = []
        self.start, self.slope, self.shift = -4.0, 1.0, 0.0
        self.thresholds = dict.fromkeys(KINDS, 2.0)
        fit = np.arange(len(y)) % 3 != 0
        if len(y) < 30 or len({*y[fit].tolist()}) < 2:
            return  # nothing to learn: no wide candidate is selected
        self.start = float(np.log(y[fit].mean() / (1 - y[fit].mean())))
        cuts = [(f, float(t)) for f in range(x.shape[1]) for t in np.unique(np.quantile(x[fit, f], np.linspace(0.03, 0.97, THRESHOLDS)))]
        sides = np.stack([x[:, f] > t for f, t in cuts], axis=1).astype(float)
        z = np.full(len(y), self.start)

        def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> int:
            s = sides[rows]
            gr, hr = s.T @ g[rows], s.T @ h[rows]
            gl, hl = g[rows].sum() - gr, h[rows].sum() - hr
            return int(np.argmax(gl**2 / (hl + 1) + gr**2 / (hr + 1)))

        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            root = best(fit, g, h)
            tree = [cuts[root]]
            for side in (0, 1):
                rows = fit & (sides[:, root] == side)
                k = best(rows, g, h) if rows.any() else root
                leaves = []
                for under in (0, 1):
                    leaf = rows & (sides[:, k] == under)
                    leaves.append(float(RATE * g[leaf].sum() / (h[leaf].sum() + 1)))
                tree.append((cuts[k], *leaves))
                z += np.where(sides[:, root] == side, np.where(sides[:, k] == 1, leaves[1], leaves[0]), 0)
            self.trees.append(tuple(tree))
        zc, yc = z[~fit], y[~fit]
        for _ in range(300):  # Platt's scaling by gradient steps
            p = 1 / (1 + np.exp(-(self.slope * zc + self.shift)))
            self.slope -= 0.05 * float(((p - yc) * zc).mean())
            self.shift -= 0.5 * float((p - yc).mean())
        p = 1 / (1 + np.exp(-(self.slope * zc + self.shift)))
        for k, name in enumerate(KINDS):
            own = kind[~fit] == k
            order = np.argsort(-p[own], kind="stable")
            sure = p[own][order]
            # A threshold lies between different scores, so that it never parts equal ones.
            ends = np.flatnonzero(np.append(sure[1:] != sure[:-1], True)) if len(sure) else order
            precise = (np.cumsum(yc[own][order]) / np.arange(1, len(order) + 1))[ends] >= PRECISION
            if precise.any():
                # Halfway to the next lower score, at which the precision would be too low.
                last = int(np.flatnonzero(precise)[-1])
                under = sure[ends[last + 1]] if last + 1 < len(ends) else sure[ends[last]]
                self.thresholds[name] = float(sure[ends[last]] + under) / 2

    def probability(self) -> Column:
        z = F.lit(self.start)
        for (f, t), (a, a0, a1), (b, b0, b1) in self.trees:
            side = lambda cut, lo, hi: F.when(F.col(f"f{cut[0]}") > cut[1], hi).otherwise(lo)
            z = z + F.when(F.col(f"f{f}") > t, side(b, b0, b1)).otherwise(side(a, a0, a1))
        return 1 / (1 + F.exp(-(z * self.slope + self.shift)))

    def threshold(self) -> Column:
        out = F.lit(2.0)
        for k, t in self.thresholds.items():
            out = F.when(F.col("kind") == k, F.lit(t)).otherwise(out)
        return out


def with_check_digit(number: str) -> str:
    total = sum(v - 9 * (v > 9) for v in (int(c) * (2 - i % 2) for i, c in enumerate(reversed(number))))
    return number + str(-total % 10)


def grouped(number: str, sizes: tuple[int, ...], sign: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(number[at : at + n])
        at += n
    return sign.join([*out, number[at:]] if at < len(number) else out)


class Examples:
    """Texts with a span of known truth, of forms that the strict patterns leave out."""

    def __init__(self, seed: int, strict: list[tuple[str, str, str]] = (), words: list[str] = ()) -> None:
        import random

        self.r = random.Random(seed)
        self.strict = {k: [(m, b) for kind, m, b in strict if kind == k] for k in KINDS}
        self.words = list(words) or ["and then", "the list shows", "more of it,", "below it says"]

    def number(self, n: int) -> str:
        return str(self.r.randint(1, 9)) + "".join(self.r.choice("0123456789") for _ in range(n - 1))

    def word(self) -> str:
        return "".join(self.r.choice("abdeiklmnorstu") for _ in range(self.r.randint(2, 9)))

    def neutral(self) -> str:
        return self.r.choice(self.words) + " "

    def found(self, kind: str, made: str) -> tuple[str, str]:
        """A strict match and the text before it: half of the time one of the sample's, otherwise a made-up one after a cue."""
        cues = {"email": ("mail: ", "contact ", "write to "), "ip": ("host ", "addr: ", "server "), "card": ("card ", "Visa ", "credit card: "), "phone": ("tel. ", "phone: ", "call ")}
        if self.strict[kind] and self.r.random() < 0.5:
            return self.r.choice(self.strict[kind])
        return made, self.r.choice((*cues[kind], self.neutral()))

    def true(self, kind: str) -> tuple[str, str]:
        """Text before, and a span that is personal data."""
        r = self.r
        if kind == "email":
            match, before = self.found(kind, f"{self.word()}{r.choice(('', '.', '_'))}{self.word()}@{self.word()}.{r.choice(('com', 'org', 'net', 'de', 'co.uk'))}")
            local, _, domain = match.partition("@")
            a, b = r.choice(("()", "[]", "{}"))
            at, dot = r.choice((f"{a}at{b}", f" {a}at{b} ")), r.choice((f" {a}dot{b} ", f"{a}dot{b}", "."))
            return before, local + at + domain.replace(".", dot)
        if kind == "ip":
            before = self.found(kind, "")[1]
            groups = [f"{r.randrange(r.choice((2, 16, 4096, 65536, 65536))):x}" for _ in range(8)]
            if r.random() < 0.5:
                return before, ":".join(groups)
            return before, ":".join(groups[: r.randint(2, 4)]) + "::" + ":".join(groups[: r.randint(1, 2)])
        if kind == "card":
            match, before = self.found(kind, with_check_digit(r.choice("3456") + self.number(14)))
            number = "".join(c for c in match if c.isdigit())
            return before, grouped(number, (4, 4, 4), r.choice((".", "/", "_")))
        match, before = self.found(kind, "+" + self.number(11))
        number = "".join(c for c in match if c.isdigit())[-10:].rjust(10, "2")
        a, b, c = number[:3], number[3:6], number[6:]
        return before, r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"))

    def false(self, kind: str) -> tuple[str, str]:
        """Text before, and a span that looks like personal data but is none."""
        r = self.r
        before = r.choice((self.neutral(), r.choice(("order ", "item ", "version ", "pages ", "ref. ", "ISBN ", "from ", "serial no. ", "years ", "total "))))
        year = str(r.randint(1900, 2039))
        if kind == "email":
            return self.neutral(), f"{self.word()} {r.choice(('(at)', '[at]'))} {self.word()}. {self.word().title()}"
        if kind == "ip":
            n = r.choice((3, 3, 4, 6))
            clock = [f"{r.randrange(60):02d}" for _ in range(n)]
            mac = [f"{r.randrange(256):02x}" for _ in range(6)]
            return before, ":".join(r.choice((clock, mac, [str(r.randrange(1, 20)) for _ in range(n)])))
        if kind == "card":
            stamp = f"{year}{r.randint(1, 12):02d}{r.randint(1, 28):02d}{self.number(r.choice((6, 8)))}"
            number = r.choice((self.number(r.randint(12, 19)), stamp, "978" + self.number(10)))
            return before, r.choice((number, grouped(number, (4, 4), r.choice("-./_ ")), grouped(number, (3, 1, 2, 6), "-"), grouped(number, (4, 2, 2, 2, 2), r.choice("-._/"))))
        sign = r.choice("- .")
        round_ = sign.join(str(r.randint(1, 9) * 10 ** r.choice((2, 3))) for _ in range(3))
        series = sign.join((year, self.number(4), self.number(r.choice((3, 4)))))
        years = sign.join(str(r.randint(1900, 2039)) for _ in range(3))
        return before, r.choice((round_, series, years, sign.join((self.number(2), self.number(4), self.number(4)))))

    def rows(self, each: int) -> list[tuple[int, str, int, int, str, bool]]:
        """doc_id, text, start and end of the span, kind, truth."""
        out = []
        for kind in KINDS:
            for i in range(2 * each):
                before, span = (self.true if i % 2 else self.false)(kind)
                out.append((len(out), f"{before}{span}{self.r.choice((' ', '. ', ', ', ''))}", len(before), len(before) + len(span), kind, bool(i % 2)))
        self.r.shuffle(out)
        return [(i, *row[1:]) for i, row in enumerate(out)]


def examples(documents: DataFrame, seed: int = 1, each: int = EXAMPLES) -> DataFrame:
    """Wide candidates of examples made from a bounded sample of documents, with features and truth."""
    spark = documents.sparkSession
    some = thinned(documents.select("doc_id", "text"), F.xxhash64("text", F.lit(31), "doc_id"), SAMPLE_DOCUMENTS)
    valid = judged(candidates(some).where("kind is not null and strict")).where("valid").select("kind", "match", "before", F.xxhash64("match", "first", "k2").alias("h"))
    strict = [tuple(r)[:3] for r in valid.orderBy("h", "kind", "match", "before").limit(4 * each).collect()]
    words = [r[0] for r in some.where("text <> ''").select(F.substring("text", 1, LEFT).alias("w"), F.xxhash64("text").alias("h")).orderBy("h", "w").limit(each).collect()]
    words = [w for w in words if not any(c.isdigit() for c in w)]
    made = spark.createDataFrame(Examples(seed, strict, words).rows(each), "doc_id long, text string, start long, stop long, truth_kind string, truth boolean")
    wide = judged(candidates(made)).where("kind is not null and not strict")
    truth = made.select("doc_id", "start", "stop", "truth_kind", "truth")
    both = wide.join(F.broadcast(truth), "doc_id").where(F.col("kind") == F.col("truth_kind"))
    # A candidate of the kind in question is personal data if the span that it meets is.
    return both.withColumn("y", (F.col("truth") & (F.col("first") < F.col("stop")) & (F.col("last") > F.col("start"))).cast("double"))


def fit(documents: DataFrame, seed: int = 1, each: int = EXAMPLES) -> Trees:
    """Trees from wide candidates of known truth."""
    names = [f"f{i}" for i in range(FEATURES)]
    got = examples(documents, seed, each).select("doc_id", "first", "kind", "y", *names).collect()
    got = sorted(map(tuple, got))
    values = np.array([r[3:] for r in got], float).reshape(-1, FEATURES + 1)
    return Trees(values[:, 1:], values[:, 0], np.array([KINDS.index(r[2]) for r in got], np.int64))


def find(documents: DataFrame, trees: Trees | None = None) -> DataFrame:
    """Per row: doc_id, k2 (hash of id and text), base and all: arrays of start, rank, end, kind in order."""
    model = trees or fit(documents)
    rank = F.lit(0)
    for i, k in enumerate(KINDS):
        rank = F.when(F.col("kind") == k, i).otherwise(rank)
    scored = judged(candidates(documents)).withColumn("p", F.when(F.col("strict"), F.lit(0.0)).otherwise(model.probability()))
    chosen = scored.select("doc_id", "k2", "row", "kind", "first", "last", "valid", (~F.col("strict") & (F.col("p") >= model.threshold())).alias("added"), rank.alias("rank"))
    # An added span must not touch a strict one, nor an added one that starts before it.
    w = Window.partitionBy("row").orderBy("first", "rank", F.desc("valid"), "last")
    strict_end, strict_start = F.when(F.col("valid"), F.col("last")), F.when(F.col("valid"), F.col("first"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # What follows, as a running minimum from the other end.
    ahead = Window.partitionBy("row").orderBy(F.desc("first"), F.desc("rank"), "valid", F.desc("last")).rowsBetween(Window.unboundedPreceding, -1)
    counted = F.when(F.col("valid") | F.col("added"), F.col("last"))
    checked = chosen.withColumns({"_s": F.coalesce(F.max(strict_end).over(before), F.lit(0)), "_n": F.min(strict_start).over(ahead), "_a": F.coalesce(F.max(counted).over(before), F.lit(0))})
    free = F.col("added") & (F.col("first") >= F.col("_s")) & (F.col("first") >= F.col("_a")) & (F.col("_n").isNull() | (F.col("_n") >= F.col("last")))
    span = F.struct(F.col("first").alias("start"), F.col("rank"), F.col("last").alias("end"), F.col("kind"), F.col("reach"))
    free = F.coalesce(free, F.lit(False))
    # reach: where all spans that start before this one have ended.
    taken = F.when(F.col("valid") | F.col("_free"), F.col("last"))
    checked = checked.withColumn("_free", free).withColumn("reach", F.coalesce(F.max(taken).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    free = F.col("_free")
    rows = checked.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("k2").alias("k2"), F.array_sort(F.collect_list(F.when(F.col("valid"), span))).alias("base"), F.array_sort(F.collect_list(F.when(F.col("valid") | free, span))).alias("all"))
    return rows.drop("row")


def is_(kind: str):
    return lambda x: x == kind


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(documents: DataFrame) -> DataFrame:
    """The same rows and columns; in text, every span found is replaced by its kind in brackets."""
    found = find(documents).where(F.size("all") > 0).select(F.coalesce("doc_id", F.lit(0)).alias("found1"), F.col("k2").alias("found2"), F.col("all").alias("spans")).dropDuplicates(["found1", "found2"])
    # The row is kept whole in a struct, so that no column's name can clash.
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(0)).alias("key1"), F.xxhash64("doc_id", text, F.isnull("doc_id")).alias("key2"))
    both = rows.join(found, (F.col("key1") == F.col("found1")) & (F.col("key2") == F.col("found2")), "left")
    # Overlapping spans of several kinds: a piece starts where all spans before it have ended, and shows the first's kind.
    pieces = F.transform(
        "spans",
        lambda s: F.concat(
            F.substring("row.text", (s["reach"] + 1).cast("int"), F.greatest(s["start"] - s["reach"], F.lit(0)).cast("int")),
            F.when(s["start"] >= s["reach"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit("")),
        ),
    )
    rest = F.expr("substring(row.text, cast(greatest(element_at(spans, -1).reach, element_at(spans, -1).end) as int) + 1)")
    new = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.concat(F.array_join(pieces, ""), rest))
    return both.select(F.col("row").withField("text", new).alias("row")).select("row.*").select(*documents.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, is_(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("all").alias("spans"))
