"""Personal data: span generators, boosted trees over format and context, calibrated thresholds.

DataFrame functions only.  Generators propose spans of each kind.  Those of the four base kinds
that pass their rule (digits, Luhn, parts of at most 255) always stay; further candidates
(telephone numbers of any national form, social security numbers, IBANs, card-like numbers, identity
documents, dates of birth, secrets) are proposed freely, scored by boosted trees that are written as SQL
expressions, and stay from the threshold of their kind on, where they don't overlap a base
span.  A row is worked on where it lies: no
shuffle, no Python on the executors, and time linear in the text and its spans.

The trees are fitted at the start of a query on ``EXAMPLES`` made-up candidates a kind (fixed
seed), whose features are computed by the very expressions that score documents; thresholds are
set on examples held out from the fit, so that of the examples kept at least ``PRECISION`` are right.
There are no labels of personal data to learn from: names and addresses, which format and context can't
tell, are not proposed.

Defined results: a null text counts as empty and has no spans (and stays null when redacted);
spans of one kind don't overlap, those of different kinds may, and are redacted as one stretch
named by its first span; repeated rows get equal results; an empty table gives no rows; other columns
play no part.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteward.llm.spans import each, highest, let, matches, places, text as quoted, those

#: The base kinds in their order.  Possessive and anchored at the start of a run, so
#: that each takes linear time and no deep recursion, with the same leftmost matches.
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
BASE = ("email", "ip", "card", "phone")
#: Kinds that the method adds: generator, context that speaks for it.
ADDED = {
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "ssn|social|security"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "iban|account|bank|transfer|konto|cuenta|compte"),
    "account": (r"(?<![0-9.])[0-9](?:[\x20-]?[0-9]){11,18}+(?![0-9.])", "card|visa|mastercard|amex|credit|debit|account|carte|tarjeta|karte"),
    "birth": (r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9./-])", "born|birth|dob|birthday|geboren|naissance|nacido|nacida|nacimiento|geburtsdatum"),
    "identity": (r"(?<![A-Za-z0-9-])[A-Z]{1,3}[ -]?[0-9]{6,9}[A-Z]?(?![A-Za-z0-9-])", "passport|identity|driver|drivers|licence|license|ausweis|pasaporte|passeport|dni|nie|national"),
    "tel": (
        r"(?<![0-9A-Za-z+./-])(?:00[1-9][0-9]{0,2}[ ./-]?)?(?:\([0-9]{1,5}\)[ ./-]?|[0-9]{2,5}[ ./-])[0-9]{2,8}(?:[ ./-][0-9]{2,6}){0,4}(?![0-9A-Za-z/-]|\.[0-9])",
        "phone|telephone|tel|call|mobile|cell|fax|contact|dial|whatsapp|sms|number is|number|telefon|rufnummer|handy|telefono|movil|llame|portable",
    ),
    "secret": (r"(?i)(?<![A-Za-z0-9])(?:token|password|passwd|secret|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{8,}+", "token|password|passwd|secret|key|login"),
}
AGAINST = r"(?:order|item|part|ref|reference|page|pages|isbn|doi|version|serial|invoice|sku|lot|model|room|table|row|no|nr|id|ticket|chapter|section|score|results?|range|between|from|years?|in|on|of|code|build|figure|fig|released|published|dated|since|until)[^a-z0-9]{0,4}$"
KINDS = (*BASE, *ADDED)
CONTEXT = 28
BLOCK = 4096
EXAMPLES = 400
TREES, DEPTH_RATE, PRECISION = 24, 0.3, 0.98
FEATURES = ("digits", "letters", "length", "distinct", "luhn", "speaks_for", "speaks_against", "hex", "mixed", "groups", "leads", "year", "ends")
SPAN = "array<struct<start:bigint,ord:int,end:bigint,kind:string,value:string,before:string>>"


def _spans(body: str, name: str, regex: str, gate: str, order: int) -> str:
    """(start, ord, end, kind, value, before) of every match, in code points; before: what stands ahead of it."""
    size = lambda x: f"cast(length({x}) AS BIGINT)"

    def made(start: str, end: str, match: str, gap: str) -> str:
        return f"named_struct('start', {start}, 'ord', {order}, 'end', {end}, 'kind', '{name}', 'value', {match}, 'before', substring({gap}, -{CONTEXT}, {CONTEXT}))"

    return f"coalesce(CASE WHEN {gate} THEN {matches(body, quoted(regex), size, size, made)} END, cast(array() AS {SPAN}))"


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """Whether a string of digits has the check digit of payment cards."""
    back = f"reverse({digits})"
    worth = lambda d, i: f"CASE WHEN {i} % 2 = 0 THEN CASE WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END ELSE {d} END"
    return f"aggregate(sequence(1, length({digits})), 0, (total, place) -> total + {let(f'ascii(substring({back}, place, 1)) - 48', lambda d: worth(d, 'place'))}) % 10 = 0"


def _holds(name: str, v: str) -> str:
    if name == "ip":
        return f"rlike({v}, {quoted(rf'^{BYTE}(?:[.]{BYTE}){{3}}$')})"
    n = f"length({_digits(v)})"
    if name == "card":
        return f"CASE WHEN {n} BETWEEN 14 AND 19 THEN {luhn(_digits(v))} ELSE false END"
    return f"{n} BETWEEN 10 AND 15" if name == "phone" else "true"


def features(kind: str, value: str, ahead: str) -> str:
    """FEATURES of a candidate, as an array of numbers.  Each value that several of them use is bound once."""
    flag = lambda c: f"CASE WHEN {c} THEN 1D ELSE 0D END"
    number = lambda c: f"cast({c} AS DOUBLE)"
    body = f"regexp_extract({value}, '[A-Za-z0-9+/_-]+$', 0)" if kind == "secret" else value
    speaks = quoted(rf"(?<![a-z])(?:{ADDED[kind][1]})(?:[^a-z]{{0,8}}| (?:is|at|me at|us at|on|no|nr|number|at the|date|of birth|id|card)[^a-z]{{0,6}})$")

    def made(body: str, digits: str, low: str) -> str:
        n, letters = f"length({digits})", f"length(regexp_replace({body}, '[^A-Za-z]', ''))"
        year = f"regexp_extract({body}, '(?:^|[^0-9])((?:19|20)[0-9]{{2}})(?:$|[^0-9])', 1)"
        return ", ".join((
            number(n), number(letters), number(f"length({body})"), number(f"size(array_distinct(split(substring({body}, 1, 40), '')))"),
            flag(f"CASE WHEN {n} BETWEEN 12 AND 19 THEN {luhn(digits)} ELSE false END"),
            flag(f"rlike({low}, {speaks})") if kind != "secret" else "1D",
            flag(f"rlike({low}, {quoted('(?<![a-z])' + AGAINST)})"),
            flag(f"rlike({body}, '^[0-9a-fA-F]{{12,}}$')"), flag(f"{n} > 1 AND {letters} > 1"),
            number(f"regexp_count({body}, '[0-9]+')"), flag(f"rlike({body}, {quoted(r'^(?:0|[(]0|[(][0-9]{3}[)])')})"), flag(f"{year} <> ''"), number(f"length(regexp_extract({body}, '[0-9]+$', 0))"),
        ))

    return let(body, lambda b: let(_digits(b), lambda d: let(f"lower({ahead})", lambda low: f"array({made(b, d, low)})")))


#: Phrases before made-up candidates, for and against, and ones that say nothing.
SPEAKS = {
    "tel": ("call me at ", "phone: ", "tel ", "Tel.: ", "mobile ", "contact ", "my number is ", "fax: ", "Telefon ", "whatsapp ", "Handy: ", "call "),
    "ssn": ("ssn ", "SSN: ", "social security: ", "social security number "), "iban": ("iban: ", "IBAN ", "account ", "bank account "),
    "account": ("card ", "visa: ", "credit card no. ", "account ", "debit card: "), "birth": ("born on ", "date of birth: ", "DOB ", "birthday ", "geboren "),
    "identity": ("passport ", "passport no. ", "national id ", "driver license ", "Ausweis "), "secret": ("",),
}
DENIES = ("order ", "part no. ", "ref: ", "isbn ", "serial ", "invoice ", "version ", "item ", "released on ", "pages ", "score ", "ticket ", "from ", "in ", "model ", "published ")
SILENT = ("the ", "and then ", "was ", "of about ", "", "with the ", "after ", "are ")


def examples() -> list[tuple[str, str, str, int]]:
    """(kind, value, ahead, label): made-up candidates, the same each time."""
    r = random.Random(20240)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    cap = lambda n: "".join(r.choice("ABCDEFGHKLMNPRSTXYZ") for _ in range(n))

    def date() -> str:
        d, m, y = r.randint(1, 28), r.randint(1, 12), r.randint(1930, 2024)
        return r.choice([f"{d:02}.{m:02}.{y}", f"{d}/{m}/{y}", f"{y}-{m:02}-{d:02}"])

    def telephone() -> str:
        shape = r.choice(["({3}) {3}-{4}", "{3}-{3}-{4}", "{3}.{3}.{4}", "0{3} {8}", "0{2} {8}", "0{4}/{6}", "0{1} {2} {2} {2} {2}", "00{2} {3} {7}", "{3} {3} {3}", "0{3}-{7}"])
        for n in range(1, 9):
            while "{%d}" % n in shape:
                shape = shape.replace("{%d}" % n, num(n), 1)
        return shape

    def numbers() -> str:
        return r.choice([f"{num(2)} {num(3)}", f"{num(3)} {num(3)}", f"{num(2)}-{num(2)}", f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}", f"{num(2)}/{num(4)}", f"{num(2)} {num(2)} {num(2)}", f"{num(2)}.{num(3)}.{num(3)}", f"{num(4)} {num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(2)}.{num(2)}.{r.randint(1950, 2030)}"])

    out = []
    for kind in ADDED:
        for i in range(EXAMPLES):
            yes = i % 2
            ahead = r.choice(SPEAKS[kind]) if yes else r.choice(DENIES + SILENT)
            if kind == "tel":
                value = telephone() if yes else r.choice([telephone, numbers, numbers])()
            elif kind == "ssn":
                value = f"{num(3)}-{num(2)}-{num(4)}"
            elif kind == "iban":
                value = r.choice(["DE", "FR", "ES", "GB"]) + num(2) + "".join(f" {num(4)}" for _ in range(4)) if yes else cap(2) + num(2) + "".join(r.choice([num(4), cap(4)]) for _ in range(r.randint(3, 5)))
                ahead = r.choice(SPEAKS[kind] + SILENT[:2]) if yes else r.choice(DENIES)
            elif kind == "account":
                value = num(r.choice([13, 15, 16, 16, 19]))
            elif kind == "birth":
                value = date()
            elif kind == "identity":
                value = cap(r.choice([1, 2])) + num(r.choice([6, 7, 8, 9]))
            else:
                body = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([16, 18, 20, 32]))) if r.random() < 0.6 else "".join(r.choice("ABCDEFGHabcdefgh0123456789") for _ in range(r.randint(12, 30)))
                word = "".join(r.choice(["the", "ra", "tion", "er", "on", "in"]) for _ in range(r.randint(4, 6)))
                value = r.choice(["token = ", "password=", 'secret: "', "api_key="]) + (body if yes else word)
                ahead = r.choice(SILENT)
            out.append((kind, value, ahead, yes))
    return out


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list]:
    """Start value and trees of depth two ((feature, cut), (left), (right)) of a logistic loss."""
    start = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    f, trees = np.full(len(y), start), []

    cuts, place = zip(*(np.unique(x[:, k], return_inverse=True) for k in range(x.shape[1])))

    def best(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray):
        """The split of greatest gain: sums up to each cut of each feature."""
        found, g, h = None, grad[rows].sum(), hess[rows].sum()
        for k, (values, at) in enumerate(zip(cuts, place, strict=True)):
            if len(values) < 2:
                continue
            gl = np.bincount(at[rows], grad[rows], len(values)).cumsum()[:-1]
            hl = np.bincount(at[rows], hess[rows], len(values)).cumsum()[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            n = int(np.argmax(gain))
            if found is None or gain[n] > found[0] + 1e-9:
                found = (float(gain[n]), k, float(values[n]))
        return found

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        grad, hess = y - p, p * (1 - p)
        every = np.arange(len(y))
        root = best(every, grad, hess)
        if root is None or root[0] < 1e-3:
            break
        sides = []
        for side in (x[:, root[1]] <= root[2], x[:, root[1]] > root[2]):
            rows = every[side]
            split = best(rows, grad, hess)
            parts = [rows] if split is None or split[0] < 1e-6 else [rows[x[rows, split[1]] <= split[2]], rows[x[rows, split[1]] > split[2]]]
            values = [float(DEPTH_RATE * grad[q].sum() / (hess[q].sum() + 1)) for q in parts]
            for q, v in zip(parts, values, strict=True):
                f[q] += v
            sides.append((None, values[0], values[0]) if len(parts) == 1 else ((split[1], split[2]), *values))
        trees.append(((root[1], root[2]), *sides))
    return start, trees


def margin(model: tuple[float, list], x: str) -> str:
    """The sum of the trees over an array of features: a fold over a table of them."""

    def row(tree) -> str:
        (k, cut), *sides = tree
        parts = [f"{k}, {cut!r}D"]
        for s in sides:  # a side without a split of its own has the same value twice
            parts.append(f"{0 if s[0] is None else s[0][0]}, {0.0 if s[0] is None else s[0][1]!r}D, {s[1]!r}D, {s[2]!r}D")
        return "struct(" + ", ".join(parts) + ")"

    side = lambda k, cut, low, high: f"CASE WHEN get({x}, t.col{k}) <= t.col{cut} THEN t.col{low} ELSE t.col{high} END"
    step = f"m + CASE WHEN get({x}, t.col1) <= t.col2 THEN {side(3, 4, 5, 6)} ELSE {side(7, 8, 9, 10)} END"
    return f"aggregate(array({', '.join(map(row, model[1]))}), {model[0]!r}D, (m, t) -> {step})" if model[1] else f"{model[0]!r}D"


def valued(model: tuple[float, list], x: np.ndarray) -> np.ndarray:
    f = np.full(len(x), model[0])
    for (k, cut), *sides in model[1]:
        for here, s in zip((x[:, k] <= cut, x[:, k] > cut), sides, strict=True):
            f += here * (s[1] if s[0] is None else np.where(x[:, s[0][0]] <= s[0][1], s[1], s[2]))
    return f


@lru_cache(maxsize=1)  # the examples are fixed
def learned(spark: SparkSession) -> dict[str, tuple[tuple[float, list], float]]:
    """Of each kind its trees and the threshold on their margin, from made-up candidates alone."""
    made = spark.createDataFrame(examples(), "kind string, value string, ahead string, y int").coalesce(1)
    whole = "CASE kind " + " ".join(f"WHEN '{kind}' THEN {features(kind, 'value', 'ahead')}" for kind in ADDED) + " END"
    rows = made.select("kind", "y", F.expr(whole).alias("x")).collect()
    out = {}
    for kind in ADDED:
        own = [r for r in rows if r["kind"] == kind]
        x, y, part = np.array([r["x"] for r in own]), np.array([r["y"] for r in own], dtype=float), np.arange(len(own)) % 10 < 7
        model = fit(x[part], y[part])
        f, y = valued(model, x)[~part], y[~part]
        cuts = [c for c in np.unique(f) if y[f >= c].mean() >= PRECISION]
        out[kind] = model, float(max(0.0, min(cuts))) - 1e-9 if cuts else float("inf")
    return out


_BARE = "named_struct('start', {0}.start, 'ord', {0}.ord, 'end', {0}.end, 'kind', {0}.kind)"
_FAR = 1 << 40


def _clear(base: str, more: str) -> str:
    """The base spans, and the candidates that meet none of them: in order of start, each against the furthest base
    end before it and, from behind, the nearest base start after it."""

    def pick(every: str) -> str:
        ours = lambda s: f"{s}.ord < {len(BASE)}"
        ends = each(every, lambda s, _: f"CASE WHEN {ours(s)} THEN {s}.end ELSE -1L END")
        starts = each(f"reverse({every})", lambda s, _: f"CASE WHEN {ours(s)} THEN {_FAR}L - {s}.start ELSE -1L END")
        free = lambda e, b, s, i: f"{ours(s)} OR (get({e}, {i}) <= {s}.start AND {_FAR}L - get({b}, {i}) >= {s}.end)"
        return let(highest(ends), lambda e: let(f"reverse({highest(starts)})", lambda b: those(every, lambda s, i: free(e, b, s, i))))

    both = f"array_sort(concat({base}, {each(more, lambda s, _: _BARE.format(s))}))"
    return f"CASE WHEN size({more}) > 0 THEN {let(both, pick)} ELSE {base} END"


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``_t`` (the text, not null), ``_base`` and ``_all``: sorted arrays of (start, ord, end, kind) in code points."""
    models = learned(docs.sparkSession)
    df = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_d", F.rlike("_t", F.lit("[0-9]")))
    gates = {"email": "contains(_t, '@')", "phone": "contains(_t, '+') AND _d", "secret": "rlike(_t, '[=:]')"}
    regexes = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE} | {k: v[0] for k, v in ADDED.items()}
    spans = {name: _spans("_t", name, regexes[name], gates.get(name, "_d"), order) for order, name in enumerate(KINDS)}

    def held(name: str) -> str:
        return each(those(spans[name], lambda s, _: _holds(name, f"{s}.value")), lambda s, _: _BARE.format(s))

    def good(name: str) -> str:
        model, least = models[name]
        return those(spans[name], lambda s, _: f"{let(features(name, f'{s}.value', f'{s}.before'), lambda x: margin(model, x))} >= {least!r}D" if np.isfinite(least) else "false")

    base, more = ", ".join(map(held, BASE)), ", ".join(map(good, ADDED))
    df = df.withColumns({"_base": F.expr(f"array_sort(concat({base}))"), "_more": F.expr(f"concat({more})")})
    return df.withColumn("_all", F.expr(_clear("_base", "_more"))).drop("_d", "_more")


def written(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _piece(blocks: str, start: str, end: str) -> str:
    """Code points start to end of a text that is cut into blocks, so that no piece is searched from the text's start."""
    first, last = f"({start}) div {BLOCK}", f"(({end}) - 1) div {BLOCK}"
    cut = lambda x, i: (
        f"substring({x}, cast(CASE WHEN {i} = 0 THEN ({start}) % {BLOCK} + 1 ELSE 1 END AS INT), "
        f"cast(least(({end}) - ({first} + {i}) * {BLOCK}, {BLOCK}) - CASE WHEN {i} = 0 THEN ({start}) % {BLOCK} ELSE 0 END AS INT))"
    )
    parts = each(f"slice({blocks}, cast({first} + 1 AS INT), cast({last} - {first} + 1 AS INT))", cut)
    return f"CASE WHEN {end} > {start} THEN array_join({parts}, '') ELSE '' END"


def _redacted(body: str, spans: str) -> str:
    """Spans that meet make one stretch: it begins where nothing before reaches, and ends at the furthest end before the next."""

    def written_(most: str, size: str) -> str:
        opens = those(places(spans), lambda i, _: f"CASE WHEN {i} = 0 THEN true ELSE get({spans}, {i}).start >= get({most}, {i} - 1) END")

        def joined(opens: str, blocks: str) -> str:
            behind = lambda i, k: f"CASE WHEN {k} > 0 THEN get({most}, {i} - 1) ELSE 0L END"
            part = lambda i, k: let(behind(i, k), lambda b: let(f"get({spans}, {i})", lambda s: f"concat({_piece(blocks, b, f'{s}.start')}, '[', upper({s}.kind), ']')"))
            tail = let(f"get({most}, size({spans}) - 1)", lambda b: _piece(blocks, b, size))
            return f"concat(array_join({each(opens, part)}, ''), {tail})"

        return let(opens, lambda opens: let(f"regexp_extract_all({body}, {quoted('(?s).{1,%d}' % BLOCK)}, 0)", lambda blocks: joined(opens, blocks)))

    return let(highest(each(spans, lambda s, _: f"{s}.end")), lambda most: let(f"cast(length({body}) AS BIGINT)", lambda size: written_(most, size)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every found stretch replaced by the name of its first kind in brackets."""
    # The row is kept apart, so that no column of it meets those made here.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    df = find(own, "text")
    new = F.expr(f"CASE WHEN size(_all) > 0 THEN {_redacted('_t', '_all')} ELSE text END")
    return df.select(*[new.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    df = find(docs.select("doc_id", "text"))
    count = lambda name: F.size(F.filter("_base", lambda s: s["kind"] == F.lit(name))).cast("long").alias(f"n_{name}")
    return df.select("doc_id", *[count(n) for n in BASE], F.sha2(written("_base"), 256).alias("base_sha256"), written("_all").alias("spans"))
