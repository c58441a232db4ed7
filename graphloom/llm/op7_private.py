"""Personal data: generators, boosted trees and calibrated thresholds, all in SQL expressions.

Base spans (email, ip, card, phone) come from fixed patterns and checks and
always stay. Beside them, high-recall generators propose spans that may overlap:
number groups, key-like tokens, spelled-out addresses and account codes.
Gradient boosted trees score each proposal by its format and context; a
proposal is selected from its generator's threshold on, which is calibrated to
a precision. Of selected
proposals that overlap, the one with the higher probability stays; none stays
that touches a base span. redacted() puts the kind in place of each span.

The trees are fitted here, on a bounded set of EXAMPLES labelled texts that
SQL expressions make up from templates, and are then one SQL expression. Every other
template is kept from them whole: thresholds are calibrated on kinds of text that the
trees have not seen. The
scan over the documents has no join, no shuffle and no code outside the JVM.

Positions come from two views of one pattern: the matches, and the pieces
between them, whose lengths in code points add up to every match's place.
Patterns use possessive repeats and anchored starts, so long runs of one
character class take linear time.

Defined results. Null and empty texts have no spans. Repeated rows give
repeated result rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kinds, in the order in which spans of one start are listed.
BASE = ["email", "ip", "card", "phone"]
ADDED = ["number", "key", "address", "account"]
KINDS = BASE + ADDED

_LOCAL = "[A-Za-z0-9._%+-]"
#: A match may begin behind another match, or where no character of the class stands before.
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

GENERATORS = {
    "number": r"(?<![0-9A-Za-z])\(?[0-9]{2,4}+[)\x20./-](?:[\x20]?+[0-9]{1,6}+[\x20./-]?+){1,5}+",
    "key": r"(?<![A-Za-z0-9+/_])[A-Za-z0-9+/_-]{12,}+",
    "address": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,}+\x20?[\[(]\x20?(?:at|AT|@)\x20?[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(]\x20?(?:dot|DOT)\x20?[\])]|\.)\x20?[A-Za-z0-9-]++)+",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
EXAMPLES = 4000
PRECISION = 0.95
TREES, RATE = 24, 0.4
CONTEXT = 24

SPAN = "struct<s:int,e:int,m:string>"


def found(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>>: start, end and text of the leftmost matches that do not overlap, in code points."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    zipped = F.zip_with(between, matches, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + x["gap"]
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))
        return F.struct(e.alias("at"), F.when(x["m"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(one))).alias("out"))

    return F.aggregate(zipped, start, step)["out"]


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    values = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


_GATE = {"email": "@", "phone": "+"}
_PASS = {
    "email": (EMAIL, None, lambda m: F.lit(True)),
    "ip": (IP, r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", lambda m: F.forall(F.split(m, r"\."), _small)),
    "card": (CARD, r"[0-9](?:[\x20-]?+[0-9]){13}", lambda m: F.length(digits(m)).between(14, 19) & luhn(digits(m))),
    "phone": (PHONE, r"\+[0-9]", lambda m: F.length(digits(m)).between(10, 15)),
}


def base_spans(text: Column, kind: str) -> Column:
    """The base spans of a kind: array<struct<s, e, m>>."""
    pattern, gate, keep = _PASS[kind]
    gates = [F.contains(text, F.lit(_GATE[kind]))] if kind in _GATE else []
    gates += [text.rlike(gate)] if gate else []
    worth = gates[0]
    for g in gates[1:]:
        worth = worth & g
    return F.when(worth, F.filter(found(text, pattern), lambda x: keep(x["m"]))).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


_HAS_DIGIT = "[0-9]"
FEATURES = ["generator", "length", "digits", "letters", "uppers", "separators", "groups", "phone_like", "national", "date_like", "cue", "assigned", "distinct", "hex", "at", "domain"]
_CUES = r"(?i)(?:tel|phone|call|fax|mobile|cell|ssn|social|password|passwd|pwd|token|secret|key|iban|account|acct|login|mail|contact)"


def _features(x: Column, generator: Column) -> Column:
    m, before = x["m"], x["before"]
    count = lambda c: F.length(F.regexp_replace(m, c, ""))
    flag = lambda c: F.when(c, 1).otherwise(0)
    return F.array(
        generator,
        F.length(m),
        count("[^0-9]"),
        count("[^A-Za-z]"),
        count("[^A-Z]"),
        count("[0-9A-Za-z]"),
        F.size(F.split(F.trim(m), "[^0-9A-Za-z]+")),
        flag(m.rlike(r"^\(?[0-9]{3}[) .-]\x20?[0-9]{3}[ .-][0-9]{4}$")),
        flag(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        flag(m.rlike(r"^(?:(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)?[0-9]{2})$")),
        flag(before.rlike(_CUES)),
        flag(before.rlike(r"[=:]\x20?[\"']?$")),
        F.size(F.array_distinct(F.split(m, ""))),
        flag(m.rlike("^[0-9a-f]+$")),
        flag(m.rlike(r"(?i)[\[(]\x20?(?:at|@)\x20?[\])]")),
        flag(m.rlike(r"(?:(?:dot|DOT)\x20?[\])]|\.)\x20?[a-z]{2,6}$")),
    )


PROPOSAL = "struct<s:int,e:int,g:int,x:array<int>>"


def _proposal(g: int):
    return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(g).alias("g"), _features(x, F.lit(g)).alias("x"))


def _of_kind(k: int):
    return lambda x: x["k"] == k


def _span(k: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))


def proposals(text: Column) -> Column:
    """array<struct<s, e, g, x>>: spans of all generators, with the generator's number and the features."""
    out = []
    for g, (name, pattern) in enumerate(GENERATORS.items()):
        worth = text.rlike(r"[\[(]\x20?(?:at|AT|@)") if name == "address" else text.rlike(_HAS_DIGIT)
        trimmed = F.transform(
            found(text, pattern),
            lambda x: F.struct(
                x["s"].alias("s"),
                (x["s"] + F.length(F.regexp_replace(x["m"], r"[\x20./-]+$", ""))).alias("e"),
                F.regexp_replace(x["m"], r"[\x20./-]+$", "").alias("m"),
                F.substring(text, F.greatest(F.lit(1), x["s"] - CONTEXT + 1), F.least(x["s"], F.lit(CONTEXT))).alias("before"),
            ),
        )
        hits = F.filter(trimmed, lambda x: x["m"].rlike("[0-9]")) if name in ("key", "number") else trimmed
        rows = F.transform(hits, _proposal(g))
        out.append(F.when(worth, rows).otherwise(F.expr(f"cast(array() as array<{PROPOSAL}>)")))
    return F.concat(*out)


class Trees:
    """Boosted depth-two regression trees on the logistic loss."""

    def __init__(self):
        self.trees: list[tuple] = []
        self.bias = 0.0
        self.thresholds: dict[int, float] = {}

    @staticmethod
    def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
        best = (0.0, -1, 0)
        whole = g.sum() ** 2 / (h.sum() + 1)
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= cut
                a, b = h[left].sum(), h[~left].sum()
                if min(a, b) < 0.5:
                    continue
                gain = g[left].sum() ** 2 / (a + 1) + g[~left].sum() ** 2 / (b + 1) - whole
                if gain > best[0] + 1e-9:
                    best = (gain, f, int(cut))
        return best

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        rate = float(np.clip(y.mean(), 0.01, 0.99))
        self.bias = float(np.log(rate / (1 - rate)))
        margin = np.full(len(y), self.bias)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            gain, f, cut = self._split(x, g, h)
            if f < 0:
                break
            sides = []
            for side in (x[:, f] <= cut, x[:, f] > cut):
                rows = np.flatnonzero(side)
                _, f2, cut2 = self._split(x[rows], g[rows], h[rows])
                low = rows[x[rows, f2] <= cut2] if f2 >= 0 else rows
                high = rows[x[rows, f2] > cut2] if f2 >= 0 else rows[:0]
                leaf = [RATE * float(g[r].sum() / (h[r].sum() + 1)) if len(r) else 0.0 for r in (low, high)]
                margin[low] += leaf[0]
                margin[high] += leaf[1]
                sides.append((max(f2, 0), cut2, leaf[0], leaf[1] if f2 >= 0 else leaf[0]))
            self.trees.append((f, cut, *sides))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for f, cut, low, high in self.trees:
            for side, (f2, cut2, a, b) in ((x[:, f] <= cut, low), (x[:, f] > cut, high)):
                out += np.where(side, np.where(x[:, f2] <= cut2, a, b), 0)
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> Trees:
        """For each generator the least probability from which on the selected examples reach the precision."""
        p = 1 / (1 + np.exp(-self.margin(x)))
        for g in range(len(GENERATORS)):
            mine = np.flatnonzero(x[:, 0] == g)
            mine = mine[np.argsort(-p[mine], kind="stable")]
            right = np.cumsum(y[mine]) / np.arange(1, len(mine) + 1)
            last = np.append(p[mine][1:] != p[mine][:-1], True) if len(mine) else np.zeros(0, bool)
            good = np.flatnonzero((right >= precision) & last & (p[mine] >= 0.5))
            below = p[mine[good[-1] + 1 :]].max(initial=0.0) if len(good) else 0.0
            self.thresholds[g] = max(0.5, float(p[mine[good[-1]]] + below) / 2) if len(good) else 2.0  # midway to the next example
        return self

    def expression(self, x: Column) -> Column:
        """The probability, from a proposal's array of features."""
        node = lambda s: F.when(x[s[0]] <= s[1], F.lit(s[2])).otherwise(F.lit(s[3]))
        total = F.lit(self.bias)
        for f, cut, low, high in self.trees:
            total = total + F.when(x[f] <= cut, node(low)).otherwise(node(high))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """text, y: made-up texts with one thing that looks like personal data; y tells whether it is."""
    # 40 pseudo-random digits, hex digits, and letters with the digits 2 to 7 for each row
    base = spark.range(n).select(
        "id",
        F.regexp_replace(F.concat(*[F.format_string("%020d", F.abs(F.xxhash64("id", F.lit(k)))) for k in range(2)]), "^0+", "7").alias("d"),
        F.lower(F.sha2(F.col("id").cast("string"), 256)).alias("h"),
        F.translate(F.upper(F.sha2(F.concat(F.lit("k"), F.col("id").cast("string")), 256)), "0189BD", "XQHVUL").alias("k"),
    )
    d = lambda a, n: f"substr(d, {a}, {n})"
    # In pairs: the trees are fitted to the first of each, thresholds are calibrated on the second.
    positive = [
        f"concat('call (', {d(1, 3)}, ') ', {d(4, 3)}, '-', {d(7, 4)}, ' now')",
        f"concat('phone: ', {d(1, 3)}, '-', {d(4, 3)}, '-', {d(7, 4)}, '.')",
        f"concat('the one at (', {d(1, 3)}, ') ', {d(4, 3)}, '-', {d(7, 4)}, ' or')",
        f"concat('this is ', {d(1, 3)}, '.', {d(4, 3)}, '.', {d(7, 4)}, ' and')",
        f"concat('has ', {d(1, 3)}, '-', {d(4, 2)}, '-', {d(6, 4)}, ' since')",
        f"concat('ssn ', {d(1, 3)}, '-', {d(4, 2)}, '-', {d(6, 4)}, ' on file')",
        "concat('password=', substr(h, 1, 18), ' was')",
        "concat('token = \"', substr(h, 3, 40), '\" in')",
        "concat('and AKIA', substr(k, 1, 16), ' then')",
        "concat('secret: ', substr(k, 5, 12), substr(h, 9, 12), ' end')",
        "concat('api_key: ', substr(h, 7, 32), ' for')",
        "concat('login with ', substr(k, 1, 6), substr(h, 1, 14), ' here')",
        "concat('the AKIA', translate(substr(k, 20, 16), '2345', 'MNPR'), ' was')",
        "concat('it took ', translate(substr(k, 3, 20), '4567', 'RSTW'), ' once')",
        "concat('bearer ', k, h, k, ' sent')",
        "concat('session=', h, k, h, k, h, ';')",
        f"concat('pay FR', {d(1, 2)}, {d(3, 20)}, ' by')",
        f"concat('account: NL', {d(1, 2)}, 'ABNA', {d(3, 10)}, '.')",
        f"concat('from GB', {d(1, 2)}, ' WEST ', {d(3, 4)}, ' ', {d(7, 4)}, ' ', {d(11, 4)}, ' ', {d(15, 2)}, ' at')",
        f"concat('iban DE', {d(1, 2)}, ' ', {d(3, 4)}, ' ', {d(7, 4)}, ' ', {d(11, 4)}, ' ', {d(15, 4)}, ' ', {d(19, 2)}, ' to')",
        "concat('me', substr(h, 1, 3), '(at)site.org')",
        "concat('write jo', substr(h, 1, 3), ' [at] mail', substr(h, 4, 2), ' [dot] com today')",
        "concat('reach x', substr(h, 1, 4), ' (at) home', substr(h, 5, 2), ' (dot) net or')",
        "concat('mail: an', substr(h, 1, 2), '.b[at]example', substr(h, 3, 2), '[dot]org.')",
    ]
    negative = [
        f"concat('on 20', {d(1, 2)}, '-0', 1 + pmod(id, 9), '-1', pmod(id, 10), ' it')",
        f"concat('dated 1', pmod(id, 3), '/1', pmod(id, 3), '/20', {d(3, 2)}, ' as')",
        f"concat('version ', pmod(id, 9), pmod(id, 7), '.', {d(1, 1)}, '.', {d(2, 2)}, ' of')",
        f"concat('years 19', {d(1, 2)}, ' 19', {d(3, 2)}, ' 20', {d(5, 2)}, ' and')",
        f"concat('about ', {d(1, 3)}, '.', {d(4, 2)}, ' metres')",
        f"concat('pages ', {d(1, 3)}, '-', {d(4, 3)}, ' of')",
        f"concat('sum ', {d(1, 3)}, ' ', {d(4, 3)}, ' ', {d(7, 3)}, ' in all')",
        f"concat('order_number_', {d(1, 6)}, ' came')",
        f"concat('release-candidate-', {d(1, 2)}, ' is')",
        f"concat('see chapter_', {d(1, 1)}, '_section_', {d(2, 1)}, ' there')",
        f"concat('path/to/file', {d(1, 2)}, '/x we')",
        f"concat('room AB', {d(1, 2)}, ' ROOM HALL of')",
        "concat('commit ', substr(h, 1, 40), ' fixed')",
        "concat('half(at)the-best of 3')",
        f"concat('it came (at) ', {d(1, 1)}, '.', {d(2, 2)}, ' daily')",
        f"concat('sold [at] ', {d(1, 2)}, '.50 each')",
        "concat('look (at) chapter', pmod(id, 7), '.Then go')",
        "concat('met (at) noon.We left ', pmod(id, 9))",
        f"concat('line AB', {d(1, 2)}, ' CDEF GHIJ in')",
        f"concat('row XY', {d(1, 2)}, 'TEXT HERE on')",
    ]
    assert len(positive) % 2 == len(negative) % 2 == 0
    both = [(t, 1) for t in positive] + [(t, 0) for t in negative]
    pick = "CASE pmod(id, {}) {} END".format(len(both), " ".join(f"WHEN {i} THEN {t}" for i, (t, _) in enumerate(both)))
    label = "CASE WHEN pmod(id, {}) < {} THEN 1 ELSE 0 END".format(len(both), len(positive))
    return base.select("id", F.expr(pick).alias("text"), F.expr(label).alias("y"))


def train(spark: SparkSession) -> Trees:
    rows = examples(spark).select("id", "y", F.explode(proposals(F.col("text"))).alias("c")).select("id", "y", "c.x").orderBy("id", "c.s", "c.g").collect()
    x, y, half = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], dtype=float), np.array([r["id"] % 2 for r in rows])  # the template is id modulo their even number
    return Trees().fit(x[half == 0], y[half == 0]).calibrate(x[half == 1], y[half == 1])


def detect(docs: DataFrame, trees: Trees, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (doc_id by default), the text (null: empty), base and spans: array<struct<s, k, e>> in order, k the kind's number in KINDS."""
    carry = [c for c in carry or ["doc_id"] if c not in ("text", "base", "spans")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*carry).alias("row"), text.alias("text"))
    rows = rows.withColumn("any", F.col("text").rlike(r"[0-9]|@|[\[(]\x20?(?:at|AT)"))
    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")
    parts = [F.transform(base_spans(F.col("text"), kind), _span(k)) for k, kind in enumerate(BASE)]
    rows = rows.withColumn("base", F.when(F.col("any"), F.array_sort(F.concat(*parts))).otherwise(none))
    scored = F.transform(proposals(F.col("text")), lambda c: F.struct(c["s"].alias("s"), (c["g"] + len(BASE)).alias("k"), c["e"].alias("e"), trees.expression(c["x"]).alias("p")))
    least = F.array(*[F.lit(trees.thresholds[g]) for g in range(len(GENERATORS))])
    chosen = F.filter(scored, lambda c: c["p"] >= least[c["k"] - len(BASE)])
    rows = rows.withColumn("chosen", F.when(F.col("any"), chosen).otherwise(F.expr("cast(array() as array<struct<s:int,k:int,e:int,p:double>>)")))
    # One sweep by start over base spans and chosen proposals.
    fixed = F.transform("base", lambda b: F.struct(b["s"].alias("s"), b["k"].alias("k"), b["e"].alias("e"), F.lit(2.0).alias("p")))
    start = F.struct(F.lit(0).alias("wall"), F.expr("cast(array() as array<struct<s:int,k:int,e:int,p:double>>)").alias("kept"))

    def sweep(a: Column, x: Column) -> Column:
        last = F.try_element_at(a["kept"], F.lit(-1))
        touches = F.coalesce(last["e"] > x["s"], F.lit(False))
        shorter = F.when(F.size(a["kept"]) > 0, F.slice(a["kept"], 1, F.greatest(F.size(a["kept"]) - 1, F.lit(0)))).otherwise(a["kept"])
        is_base = x["k"] < len(BASE)
        kept = (
            F.when(is_base, F.when(touches, shorter).otherwise(a["kept"]))
            .when(x["s"] < a["wall"], a["kept"])
            .when(~touches, F.concat(a["kept"], F.array(x)))
            .when(x["p"] > last["p"], F.concat(shorter, F.array(x)))
            .otherwise(a["kept"])
        )
        return F.struct(F.when(is_base, F.greatest(a["wall"], x["e"])).otherwise(a["wall"]).alias("wall"), kept.alias("kept"))

    swept = F.aggregate(F.array_sort(F.concat(fixed, F.col("chosen"))), start, sweep)["kept"]
    added = F.transform(swept, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    rows = rows.withColumn("spans", F.when(F.size("chosen") > 0, F.array_sort(F.concat("base", added))).otherwise(F.col("base")))
    return rows.select("row.*", "text", "base", "spans")


def listed(spans: str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with [KIND] in place of each span; of spans that overlap, the first one's kind stands for all."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    cut = lambda low, high: F.substring(text, low + 1, high - low)
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(a: Column, x: Column) -> Column:
        apart = (x["s"] >= a["at"]) | (F.size(a["out"]) == 0)
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(apart, F.concat(a["out"], F.array(cut(a["at"], x["s"]), names[x["k"]]))).otherwise(a["out"]).alias("out"))

    done = lambda a: F.concat(F.array_join(a["out"], ""), cut(a["at"], F.greatest(F.length(text), a["at"])))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, done))


def op7_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"), train(spark))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), F.sha2(redacted(F.col("text"), F.col("spans")), 256).alias("redacted_sha256"))
