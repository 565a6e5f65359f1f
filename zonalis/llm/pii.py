"""Personal data and secrets by candidate gradient boosting, in Spark SQL expressions only.

High-recall patterns propose overlapping spans besides the base patterns. Boosted trees over the
span's format and the words before it score each proposal, and a threshold for each kind, calibrated
on held-out examples, selects. The trees are fitted on the driver on bounded examples: generated ones
(``EXAMPLES`` a template), and spans of a bounded sample of the documents themselves (``SAMPLE_DOCS``),
where a base pattern that passes its check is a good example and one that fails it is a bad one. Features
come from the same SQL. The trees are then compiled into CASE expressions: documents are read by the JVM
alone, and nothing is shuffled.

Patterns are written so that the engine needs no stack for long runs: single separators that stand
between two characters of the run are first replaced by U+0001, character by character, so that a
run is one character class.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

KINDS = ("email", "ip", "card", "phone", "secret")
#: Kinds of the base patterns.
BASE_KINDS = 4
EXAMPLES = 40
#: Documents that lend examples, about, chosen by a hash of doc_id and text; and proposals read of one.
SAMPLE_DOCS, SAMPLE_SPANS = 4000, 50
ROUNDS, RATE, SEED = 40, 0.3, 11
PRECISION = 0.99
#: Words before a span that speak for a kind, and words that speak against all.
CONTEXT = {
    "email": ("mail", "contact", "write to", "reach"),
    "ip": ("ip", "host", "server", "address", "login from"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "dial"),
    "secret": ("token", "secret", "password", "passwd", "api key", "api_key", "apikey", "credential", "private key", "access key", "access_key", "auth", "bearer"),
}
AGAINST = ("isbn", "version", "order", "invoice", "page", "serial", "part no", "section", "score", "ticket", "commit", "checksum", "digest", "md5", "sha1", "sha256", "uuid")

_LABEL = "A-Za-z0-9-"
_LOCAL = "A-Za-z0-9._%+\x01-"


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(text: str, pattern: str) -> str:
    """SQL array of (start, end, m) of the pattern's matches: they are put between marks, the text is
    split at the marks, and every second piece is a match."""
    pieces = f"split(regexp_replace({text}, {_lit('(' + pattern + ')')}, '\\u0003$1\\u0003'), '\\u0003')"
    none = "cast(array() as array<struct<start:int,end:int,m:string>>)"
    step = "named_struct('pos', a_.pos + length(p_), 'odd', not a_.odd, 'out', if(a_.odd, concat(a_.out, array(named_struct('start', a_.pos, 'end', a_.pos + length(p_), 'm', p_))), a_.out))"
    return let("ps_", pieces, f"if(size(ps_) = 1, {none}, aggregate(ps_, named_struct('pos', 0, 'odd', false, 'out', {none}), (a_, p_) -> {step}, a_ -> a_.out))")


def _digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    value = let("x_", f"cast(substr({digits}, length({digits}) - i_, 1) as int) * (1 + i_ % 2)", "if(x_ > 9, x_ - 9, x_)")
    return f"(aggregate(sequence(0, length({digits}) - 1), 0, (s_, i_) -> s_ + {value}) % 10 = 0)"


def _base(checked: bool = True) -> dict[str, str]:
    """SQL arrays of the base spans of t0 by kind; unchecked, of all that the patterns match."""
    mail = f"regexp_replace(t0, '(?<=[{_LABEL}])\\\\.(?=[{_LABEL}])', '\\u0001')"
    email = _spans(mail, rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++{chr(1)}[{_LABEL}{chr(1)}]++".replace("-\x01]", "\x01-]"))
    card = _spans("regexp_replace(t0, '(?<=[0-9])[ -](?=[0-9])', '\\u0001')", "[0-9][0-9\x01]{11,}+")
    ip = _spans("t0", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
    phone = _spans("t0", r"\+[0-9][ ().0-9-]+[0-9]")
    part = let("z_", "ltrim('0', o_)", "length(z_) <= 3 and cast(if(z_ = '', '0', z_) as int) <= 255")
    card_ok = let("d_", _digits("x_.m"), f"length(d_) between 12 and 19 and {_luhn('d_')}")
    checks = {
        "email": "true",
        "ip": f"forall(split(x_.m, '\\\\.'), o_ -> {part})",
        "card": card_ok,
        "phone": f"length({_digits('x_.m')}) between 9 and 15",
    }
    found = {"email": f"if(contains(t0, '@'), {email}, {_NONE})", "ip": ip, "card": card, "phone": f"if(contains(t0, '+'), {phone}, {_NONE})"}
    return {k: f"filter({v}, x_ -> {checks[k]})" if checked and checks[k] != "true" else v for k, v in found.items()}


_NONE = "cast(array() as array<struct<start:int,end:int,m:string>>)"


def _proposals() -> dict[str, str]:
    """SQL arrays of proposed spans of t0 by kind: wider than what is redacted in the end. The lengths of an
    address's parts and their number are those that the standards of mail and names allow."""
    hexa = "[0-9a-fA-F]{1,4}"
    at, dot = r"(?:@|\(at\)|\[at\]|at)", r"(?:\.|\(dot\)|\[dot\]|dot)"
    return {
        "email": _spans("t0", rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+ ?{at} ?[A-Za-z0-9-]{{1,63}}(?: ?{dot} ?[A-Za-z0-9-]{{2,63}}){{1,126}}"),
        "ip": _spans("t0", rf"(?<![0-9A-Za-z.:])(?:[0-9]{{1,3}}(?:\[\.\]|\(\.\))){{3}}[0-9]{{1,3}}(?![0-9A-Za-z])|(?<![0-9A-Za-z:])(?:(?:{hexa}:){{7}}{hexa}|(?:{hexa}(?::{hexa}){{0,6}})?::(?:{hexa}(?::{hexa}){{0,6}})?)(?![0-9A-Za-z:])"),
        "card": _spans("t0", r"(?<![0-9A-Za-z./_])[0-9](?:[ ./_-]?[0-9]){11,18}(?![0-9A-Za-z])"),
        "phone": _spans("t0", r"(?<![0-9A-Za-z.+/_-])(?:\([0-9]{1,5}\)[ ./-]?[0-9](?:[ ./-]?[0-9]){4,13}|[0-9](?:[ ./-]?[0-9]){6,14})(?![0-9A-Za-z/_-])"),
        "secret": _spans("t0", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9@])"),
    }


def _features(kind: str) -> str:
    """SQL array of the features of proposal x_, after the words before it (c_)."""
    has = lambda words: " or ".join(f"contains(c_, '{w}')" for w in words)
    count = lambda chars: f"cast(length(x_.m) - length(translate(x_.m, '{chars}', '')) as double)"
    number = lambda s: f"if({s}, 1D, 0D)"
    d = _digits("x_.m")
    return let(
        "c_",
        "lower(substr(t0, greatest(1, x_.start - 29), least(30, x_.start)))",
        let(
            "d_",
            d,
            f"array({float(KINDS.index(kind))}D, cast(length(d_) as double), cast(length(x_.m) as double), {count(' ')}, {count('-./_')}, {count('()[]')}, {count('@')}, "
            f"{number(has(CONTEXT[kind]))}, {number(has(AGAINST))}, {number('length(d_) >= 12 and ' + _luhn('d_'))}, {number('length(replace(d_, substr(d_, 1, 1), chr(32))) > 0 and length(trim(replace(d_, substr(d_, 1, 1), chr(32)))) = 0')}, "
            f"{number(chr(40) + 'lower(x_.m) rlike ' + _lit(r'[.\])t] ?(com|org|net|edu|gov|de|fr|es|io|uk)$') + chr(41))}, {number('x_.m rlike ' + _lit(r'^(19|20)[0-9]{2}[ ./-]'))}, {count(':')}, "
            f"cast(length(regexp_replace(x_.m, '[^A-Za-z]', '')) as double), {number('x_.m rlike ' + _lit('^(?:[0-9a-f]+|[0-9A-F]+)$'))}, cast(size(array_distinct(split(x_.m, ''))) as double), {number('x_.start > 0 and substr(t0, x_.start, 1) rlike ' + _lit('[=:' + chr(34) + ']'))})",
        ),
    )


def _proposed(kind: str, base: bool = False) -> str:
    """SQL array of (start, end, kind, features) of the proposals of a kind; with ``base``, also of what its
    base pattern matches."""
    k = KINDS.index(kind)
    spans = f"concat({_proposals()[kind]}, {_base(checked=False)[kind]})" if base else _proposals()[kind]
    return f"transform({spans}, x_ -> named_struct('start', x_.start, 'end', x_.end, 'kind', {k}, 'm', x_.m, 'f', {_features(kind)}))"


_T0 = "translate(coalesce(text, ''), '\\u0001\\u0003', '\\u0002\\u0002')"


def examples(seed: int = SEED) -> list[tuple[str, int]]:
    """Generated texts, and whether they hold personal data."""
    return [(text, label) for text, label, _ in _examples(seed)]


def _examples(seed: int) -> list[tuple[str, int, str | None]]:
    """Generated texts, whether they hold personal data, and its kind."""
    rng = random.Random(seed)
    n = lambda k: "".join(str(rng.randrange(10)) for _ in range(k))
    word = lambda: "".join(rng.choice("aeioubdfglmnrst") for _ in range(rng.randrange(3, 9)))
    tld = lambda: rng.choice(("com", "org", "net", "de", "fr"))

    def luhn(sep: str, groups: tuple[int, ...] = (4, 4, 4, 4)) -> str:
        body = n(sum(groups) - 1)
        total = sum(x - 9 if x > 9 else x for x in (int(c) * (2 - i % 2) for i, c in enumerate(reversed(body))))
        d = body + str(-total % 10)
        return sep.join(d[sum(groups[:i]) : sum(groups[: i + 1])] for i in range(len(groups)))

    def compressed() -> str:
        part = lambda k: ":".join(f"{rng.randrange(65536):x}" for _ in range(k))
        return f"{rng.choice(('fe80', 'fd00', '2001:db8', part(2)))}::{part(rng.randrange(1, 4))}"

    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    mixed = lambda chars, k: "".join([*(rng.choice(chars) for _ in range(k - 2)), "a" if chars[0] != "A" else "A", "7"])
    plain = lambda: " ".join(word() for _ in range(5))
    pro = lambda kind: f"{plain()} {rng.choice(CONTEXT[kind])} "
    con = lambda: f"{plain()} {rng.choice(AGAINST)} "
    sep = lambda: rng.choice("./_")
    templates = [
        (lambda: pro("email") + f"{word()} (at) {word()} (dot) {tld()}", "email"),
        (lambda: plain() + f" {word()}[at]{word()}[dot]{tld()}", "email"),
        (lambda: pro("email") + f"{word()} at {word()} dot {tld()}", "email"),
        (lambda: plain() + f" {word()} at {word()} dot {word()}", None),
        (lambda: plain() + f" {word()} (at) {word()}.{word()}", None),
        (lambda: pro("ip") + "[.]".join(str(rng.randrange(256)) for _ in range(4)), "ip"),
        (lambda: pro("ip") + ":".join(f"{rng.randrange(65536):x}" for _ in range(8)), "ip"),
        (lambda: con() + ":".join(n(2) for _ in range(8)), None),
        (lambda: pro("card") + luhn(sep()), "card"),
        (lambda: plain() + " " + luhn(sep()), "card"),
        (lambda: plain() + " " + (s := sep()).join((n(4), n(4), n(4), n(3))), None),
        (lambda: con() + (s := sep()).join((n(4), n(4), n(4), n(4))), None),
        (lambda: pro("phone") + f"({n(3)}) {n(3)}-{n(4)}", "phone"),
        (lambda: pro("phone") + f"{n(3)}-{n(3)}-{n(4)}", "phone"),
        (lambda: pro("phone") + f"{n(4)} {n(3)} {n(4)}", "phone"),
        (lambda: plain() + f" {n(3)} {n(3)} {n(4)}", None),
        (lambda: plain() + f" {n(3)}.{n(3)}.{n(4)}", None),
        (lambda: con() + f"{n(3)}-{n(3)}-{n(4)}", None),
        (lambda: con() + f"({n(3)}) {n(3)}-{n(4)}", None),
        (lambda: plain() + f" {rng.choice(('19', '20'))}{n(2)}-{n(3)}-{n(4)}", None),
        (lambda: plain() + " " + "-".join((rng.choice("0123456789") * 3, "000", "0000")), None),
        (lambda: plain() + f" {word()}@{word()}{rng.choice(('(dot)', '[dot]', ' dot '))}{tld()}", "email"),
        (lambda: pro("email") + f"{word()}{rng.choice((' at ', ' @ '))}{word()}.{tld()}", "email"),
        (lambda: plain() + f" {word()} @ {word()}.{tld()}", "email"),
        (lambda: plain() + f" {word()} at {word()}. {word().title()}", None),
        (lambda: pro("email") + f"{word()} at {word()}. {word().title()}", None),
        (lambda: pro("ip") + compressed(), "ip"),
        (lambda: plain() + f" {rng.choice(('', 'a', 'be'))}::{rng.choice(('', 'add', 'c'))}", None),
        (lambda: con() + compressed(), None),
        (lambda: pro("card") + luhn(rng.choice("./_"), rng.choice(((4, 6, 5), (4, 6, 4), (6, 10), (8, 8), (4, 4, 5)))), "card"),
        (lambda: plain() + " " + luhn(rng.choice("./_"), rng.choice(((4, 6, 5), (4, 6, 4), (8, 8)))), "card"),
        (lambda: plain() + " " + n(rng.randrange(12, 20)), None),
        (lambda: pro("phone") + " ".join(["0" + n(1), n(2), n(2), n(2), n(2)]), "phone"),
        (lambda: pro("phone") + "0" + n(9), "phone"),
        (lambda: pro("phone") + f"{n(3)}-{n(rng.choice((4, 7)))}", "phone"),
        (lambda: con() + rng.choice((n(7), n(10), f"{n(3)}-{n(7)}", f"{n(2)} {n(2)} {n(2)} {n(2)} {n(2)}")), None),
        (lambda: plain() + " " + rng.choice((n(7), n(8), n(10), f"{n(3)}-{n(7)}")), None),
        (lambda: plain() + f" {rng.choice(('19', '20'))}{n(2)}-{n(2)}-{n(2)}", None),
        (lambda: pro("secret") + rng.choice(("= ", ": ", "", "is ", "= \"")) + mixed("0123456789abcdef", rng.choice((32, 40, 64))), "secret"),
        (lambda: pro("secret") + rng.choice(("=", ": ", "", "= '")) + mixed(alnum, rng.randrange(20, 48)), "secret"),
        (lambda: plain() + " " + rng.choice(("token", "api_key", "password", "SECRET")) + rng.choice((" = \"", "=", ": ")) + mixed(alnum, rng.randrange(18, 44)), "secret"),
        (lambda: pro("secret") + rng.choice(("AK" + mixed(alnum[26:], 18), "sk-" + mixed(alnum, 40), "gh_" + mixed(alnum, 36))), "secret"),
        (lambda: con() + mixed("0123456789abcdef", rng.choice((32, 40, 64))), None),
        (lambda: plain() + " " + mixed("0123456789abcdef", rng.choice((32, 40, 64))), None),
        (lambda: plain() + " " + "-".join(mixed("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)), None),
        (lambda: plain() + f" https://{word()}.{tld()}/{word()}/{n(4)}/{word()}-{word()}-{n(2)}", None),
        (lambda: plain() + f" {word()}-{word()}-{word()}_{n(4)}", None),
        (lambda: pro("secret") + f"{word()}-{word()}-{word()}-{word()}{n(1)}", None),
    ]
    return [(make() + " " + word(), int(kind is not None), kind) for _ in range(EXAMPLES) for make, kind in templates]


@dataclass(frozen=True)
class Model:
    """base + RATE * trees; a tree is (feature, split, and for either side feature, split, low, high)."""

    base: float
    trees: tuple
    thresholds: tuple[float, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, s, left, right in self.trees:
            for side, rows in ((left, x[:, f] <= s), (right, x[:, f] > s)):
                g, t, low, high = side
                out[rows] += np.where(x[rows, g] <= t, low, high)
        return out

    def score_sql(self, f: str) -> str:
        leaf = lambda side: f"if({f}[{side[0]}] <= {side[1]!r}D, {side[2]!r}D, {side[3]!r}D)"
        return " + ".join([f"{self.base!r}D", *(f"if({f}[{a}] <= {s!r}D, {leaf(left)}, {leaf(right)})" for a, s, left, right in self.trees)])

    def threshold_sql(self, kind: str) -> str:
        return "case " + kind + " " + " ".join(f"when {i} then {t!r}D" for i, t in enumerate(self.thresholds)) + " end"


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float, float, float]:
    """The split of least loss: feature, value, and the Newton steps of both sides."""
    best = (-1.0, 0, 0.0, 0.0, 0.0)
    step = lambda m: float(g[m].sum() / (h[m].sum() + 1.0))
    gain = lambda m: float(g[m].sum() ** 2 / (h[m].sum() + 1.0))
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for s in (values[:-1] + values[1:]) / 2 if len(values) > 1 else values:
            low = x[:, f] <= s
            if (got := gain(low) + gain(~low)) > best[0] + 1e-9:
                best = (got, f, float(s), step(low), step(~low))
    return best[1:]


def fit(x: np.ndarray, y: np.ndarray, even: np.ndarray) -> Model:
    """Boosted trees of two levels under logistic loss on the even rows; thresholds on the others."""
    a, b = x[even], y[even]
    base = math.log((b.mean() + 1e-6) / (1 - b.mean() + 1e-6))
    score, trees = np.full(len(b), base), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        g, h = b - p, p * (1 - p)
        f, s, _, _ = _split(a, g, h)
        sides = []
        for rows in (a[:, f] <= s, a[:, f] > s):
            k, t, low, high = _split(a[rows], g[rows], h[rows]) if rows.any() else (0, 0.0, 0.0, 0.0)
            sides.append((k, t, RATE * low, RATE * high))
            score[rows] += np.where(a[rows, k] <= t, RATE * low, RATE * high)
        trees.append((f, s, *sides))
    model = Model(base, tuple(trees), ())
    held, truth = x[~even], y[~even]
    scores, thresholds = model.score(held), []
    for k in range(len(KINDS)):
        own = held[:, 0] == k
        cut = next((t for t in np.sort(scores[own]) if truth[own][scores[own] >= t].mean() >= PRECISION), np.inf)
        thresholds.append(float(max(cut, 0.0)) if np.isfinite(cut) else 1e9)
    return Model(base, tuple(trees), tuple(thresholds))


#: What an address has that is meant as one.
_DISGUISED = r"(?i)@|[(\[]at[)\]]|dot"


def sampled(docs: DataFrame, most: int = SAMPLE_DOCS) -> list[tuple[int, int, list[float], bool]]:
    """(kind, label, features, held out) of proposals in a sample of documents that meet what a base pattern
    matches: good where the match passes its check, bad where it fails. Prose with a bare ``at`` and a full
    stop is a bad e-mail address. About ``most`` documents are read,
    chosen and held out by a hash of doc_id and text."""
    total = docs.where("text is not null").count()
    mark = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    some = docs.where("text is not null").select("text", mark.alias("mark")).where(mark < (1 << 30) * min(1.0, most / max(1, total)))
    spans = {k: (good, loose) for k, good, loose in zip(KINDS, _base().values(), _base(checked=False).values(), strict=False)}
    each = []
    for kind, (good, loose) in spans.items():
        like = "exists(l_, z_ -> z_.start < c_.end and c_.start < z_.end)"
        whole = "exists(g_, z_ -> z_.start < c_.end and c_.start < z_.end)"
        like = like if kind != "email" else f"({like} or not c_.m rlike {_lit(_DISGUISED)})"
        found = f"transform(filter(slice({_proposed(kind, True)}, 1, {SAMPLE_SPANS}), c_ -> {like}), c_ -> named_struct('kind', c_.kind, 'f', c_.f, 'y', {whole}))"
        each.append(let("g_", good, let("l_", loose, found)))
    rows = some.withColumn("t0", F.expr(_T0)).select("mark", F.explode(F.expr(f"concat({', '.join(each)})")).alias("c")).select("mark", "c.*").collect()
    return [(r.kind, int(r.y), list(r.f), r.mark % 2 == 1) for r in sorted(rows, key=lambda r: (r.mark, r.kind, r.f))]


def train(spark: SparkSession, docs: DataFrame | None = None, seed: int = SEED) -> Model:
    """Fit on the generated examples and, where documents are given, on examples from a sample of them."""
    data = _examples(seed)
    texts = F.split(F.lit("\x05".join(t for t, _, _ in data)), "\x05")
    rows = spark.range(1).select(F.posexplode(texts).alias("i", "text")).withColumn("t0", F.expr(_T0))
    found = rows.select("i", F.explode(F.expr(f"concat({', '.join(map(_proposed, KINDS))})")).alias("c")).select("i", "c.kind", "c.f").orderBy("i", "f").collect()
    own = [(r.kind, int(data[r.i][2] == KINDS[r.kind]), list(r.f), r.i * EXAMPLES // len(data) % 2 == 1) for r in found]
    own += sampled(docs) if docs is not None else []
    _, labels, features, held = zip(*own, strict=True)
    return fit(np.array(features), np.array(labels, float), ~np.array(held))


def find_pii(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Add base and spans to each row: arrays of (start, kind, end), sorted; kind is an index of KINDS,
    places are code points, the end is exclusive. base holds the contract's patterns; spans holds base
    and the selected proposals.

    A proposal counts if its score reaches its kind's threshold and it meets no base span and no
    proposal of higher score (ties: of earlier start). A null or empty text has no spans; repeated
    rows are alike; an empty table gives an empty table; other columns stay, but for ``base`` and
    ``spans``. Whole texts are searched.
    """
    from .common import packed, unpacked

    model = model or train(docs.sparkSession, docs)
    own = packed(docs, t0=F.expr(_T0))
    base = "array_sort(concat(" + ", ".join(f"transform({sql}, x_ -> named_struct('start', x_.start, 'kind', {KINDS.index(k)}, 'end', x_.end))" for k, sql in _base().items()) + "))"
    scored = f"transform(concat({', '.join(map(_proposed, KINDS))}), y_ -> named_struct('start', y_.start, 'kind', y_.kind, 'end', y_.end, 'score', {model.score_sql('y_.f')}))"
    good = f"filter({scored}, y_ -> y_.score >= {model.threshold_sql('y_.kind')} and not exists(b_, z_ -> z_.start < y_.end and y_.start < z_.end))"
    ahead = "exists(g_, z_ -> z_.start < y_.end and y_.start < z_.end and (z_.score > y_.score or (z_.score = y_.score and (z_.start < y_.start or (z_.start = y_.start and z_.kind < y_.kind)))))"
    chosen = let("g_", good, f"transform(filter(g_, y_ -> not {ahead}), y_ -> named_struct('start', y_.start, 'kind', y_.kind, 'end', y_.end))")
    both = F.expr(let("b_", base, f"named_struct('base', b_, 'spans', array_sort(concat(b_, {chosen})))"))
    found = own.select("row", both.alias("found"))
    return unpacked(found, docs.columns, base=F.col("found.base"), spans=F.col("found.spans"))


def recall(docs: DataFrame, model: Model) -> dict[str, tuple[int, int]]:
    """By base kind: (checked base spans among the held-out examples of documents, those that the trees would
    select as proposals): how well the trees know what the base patterns find anyway."""
    out = {}
    held = [x for x in sampled(docs) if x[3] and x[1]]
    for k, kind in enumerate(KINDS[:BASE_KINDS]):
        f = np.array([x[2] for x in held if x[0] == k])
        out[kind] = (len(f), int((model.score(f) >= model.thresholds[k]).sum()) if len(f) else 0)
    return out


def spans_string(spans: str) -> str:
    """SQL string kind:start:end, comma-joined, of an array of spans."""
    names = "element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), s_.kind + 1)"
    return f"array_join(transform({spans}, s_ -> concat({names}, ':', s_.start, ':', s_.end)), ',')"


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    if text is None:
        return None
    out, at = [], 0
    for start, kind, end in sorted(map(tuple, spans)):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
            at = end
    return "".join([*out, text[at:]])
