"""Quantities recorded in different units: read the unit out of free text, convert to one unit.

A unit text is segmented by dynamic programming over tries of scale prefixes, unit roots,
exponents, cue words and words that only look like units. Every segment carries a weight, a
root also the prior of its dimension in the field at hand, and the best segmentation wins: a
root with several readings (`$`, `¥`, `pound`) takes the one that the field makes likeliest.
A phrase is the field's unit if its prior, with what a cue adds to it, is positive: the
currency field is expected to be a unit and nothing else, a remark is prose in which a unit
counts only where a cue states it for the amount, and a field of money takes no root of
another dimension (`1,000 rows`, `千件`). What a currency field names and the grammar cannot
read is unknown, never single yen.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.session import ship

#: Fixed vocabulary. Prefix: power of ten. Root: its readings, (dimension, power of ten) each. Exponent: power of ten.
PREFIXES = {
    "k": 3, "thousand": 3, "thousands": 3, "thousand of": 3, "thousands of": 3, "十": 1, "百": 2, "千": 3, "万": 4, "億": 8, "兆": 12,
    "ten thousand": 4, "ten thousands of": 4, "tens of thousands of": 4, "10k": 4, "lakh": 5, "lakhs": 5, "crore": 7, "crores": 7,
    "hundred thousand": 5, "million": 6, "millions": 6, "millions of": 6, "mn": 6, "mm": 6, "mio": 6, "m": 6,
    "billion": 9, "billions": 9, "billions of": 9, "bn": 9, "b": 9, "trillion": 12, "trillions": 12, "trillions of": 12, "tn": 12, "hundred": 2, "hundreds of": 2, "whole": 0, "single": 0, "full": 0,
}
#: Currencies called dollar: what stands before the word or its sign.
_DOLLARS = {"USD": ("us", "u.s.", "american"), "CAD": ("c", "ca", "can", "cad", "canadian"), "AUD": ("a", "au", "aus", "aud", "australian"), "HKD": ("hk", "hkd", "hong kong"), "NZD": ("nz", "nzd", "new zealand"), "SGD": ("s", "sg", "sgd", "singapore"), "TWD": ("nt", "twd", "taiwan", "new taiwan")}
_NAMES = {
    "JPY": "jpy|yen|円|¥|圓|japanese yen|日本円|jp¥|j¥", "USD": "usd|ドル|米ドル|米国ドル|アメリカドル|弗", "EUR": "eur|euro|euros|€|ユーロ|欧州ユーロ", "GBP": "gbp|£|pound sterling|pounds sterling|british pound|british pounds|英ポンド|ポンド",
    "CNY": "cny|rmb|cnh|yuan|renminbi|人民元|元|中国元|cn¥", "KRW": "krw|won|₩|ウォン|韓国ウォン", "CHF": "chf|swiss franc|swiss francs|スイスフラン", "CAD": "cad|カナダドル|加ドル", "AUD": "aud|豪ドル|オーストラリアドル", "HKD": "hkd|香港ドル", "NZD": "nzd|ニュージーランドドル",
    "SGD": "sgd|シンガポールドル", "TWD": "twd|台湾ドル|新台湾ドル", "INR": "inr|rupee|rupees|₹|インドルピー|ルピー", "THB": "thb|baht|฿|バーツ", "SEK": "sek|スウェーデンクローナ", "NOK": "nok|ノルウェークローネ", "DKK": "dkk|デンマーククローネ", "BRL": "brl|r$|レアル", "MXN": "mxn|mex$",
    "RUB": "rub|₽|ルーブル", "TRY": "try|₺|トルコリラ", "ZAR": "zar|南アランド", "PHP": "php|₱|フィリピンペソ", "IDR": "idr|rupiah|ルピア", "VND": "vnd|₫|ドン", "PLN": "pln|zloty", "CZK": "czk", "HUF": "huf", "ILS": "ils|₪", "MYR": "myr|ringgit|リンギット", "AED": "aed", "SAR": "sar",
    "COUNT": "row|rows|message|messages|account|accounts|件|通|人|名|行|回|社|口座|枚|個", "MASS": "kg|kilogram|kilograms|ton|tons|gram|grams|トン|グラム", "TIME": "second|seconds|minute|minutes|hour|hours|day|days|秒|分|時間|日",
}
_HUNDREDTHS = {"USD": "usc|us¢|us cent|us cents|u.s. cents|usd cent|usd cents|dollar cents|セント|米セント", "EUR": "euro cent|euro cents|eurocent|eurocents|eur cent|eur cents|ユーロセント", "GBP": "pence|penny|gbp pence|ペンス", "SHARE": "percent|%"}


def _roots() -> dict[str, tuple[tuple[str, int], ...]]:
    out: dict[str, list[tuple[str, int]]] = {}
    for power, names in ((0, _NAMES), (-2, _HUNDREDTHS)):
        for dim, words in names.items():
            for w in words.split("|"):
                out.setdefault(w, []).append((dim, power))
    for dim, marks in _DOLLARS.items():
        for power, words in ((0, ("dollar", "dollars", "$")), (-2, ("cent", "cents", "¢"))):
            for w in words:
                out.setdefault(w, []).append((dim, power))  # by itself it may be any of them
                for m in marks:
                    out.setdefault(f"{m}{w}" if w in "$¢" else f"{m} {w}", []).append((dim, power))
    for w, dim, power in (("¥", "CNY", 0), ("cent", "EUR", -2), ("cents", "EUR", -2), ("pound", "GBP", 0), ("pounds", "GBP", 0), ("pound", "MASS", 0), ("pounds", "MASS", 0)):
        out.setdefault(w, []).append((dim, power))
    return {w: tuple(dict.fromkeys(v)) for w, v in out.items()}


ROOTS = _roots()
#: The prior of a field of money: how likely each dimension is in it. What is not named is money of another kind.
MONEY_PRIOR = {"JPY": 2.0, "USD": 1.5, "EUR": 0.8, "COUNT": -4.0, "SHARE": -4.0, "MASS": -4.0, "TIME": -4.0}
OTHER_MONEY = 0.5
#: The dimension of a currency field that names a unit which the grammar cannot read.
UNKNOWN = "UNKNOWN"
#: Words that may stand beside a unit in a currency field, and those that state that it is not known.
_FILLERS = frozenset("the of a an per each net gross incl excl including excluding tax vat only currency amount amounts 税込 税抜".split())
_NOTHING = frozenset("n/a na none null nil nan - -- unknown unspecified tbd なし 不明 未定".split())
EXPONENTS = {
    "x1000": 3, "x1,000": 3, "×1000": 3, "×1,000": 3, "x10000": 4, "x10,000": 4, "x1000000": 6, "x1,000,000": 6, "(000)": 3, "(000s)": 3, "000": 3, "000s": 3, "'000": 3, "'000s": 3, "(千)": 3, "(万)": 4, "(百万)": 6,
    "1,000s": 3, "1000s": 3, "10,000s": 4, "10000s": 4, "1,000,000s": 6, "(000,000)": 6, "/100": -2, "1/100": -2, "/1000": -3, "x100": 2, "/ 100": -2, "in 1000": 3, "in 1,000": 3,
}
#: Words that state a unit for the amount, before it or after it; a later one outweighs an earlier.
CUES_BEFORE = (
    "amount in", "amounts in", "amount is in", "amounts are in", "figure in", "figures in", "figures are in", "unit", "unit is", "units are", "units", "unit:", "units:", "value is", "value in", "values in", "values are",
    "value is in", "values are in", "in", "booked in", "recorded in", "stated in", "expressed in", "reported in", "denominated in", "given in", "shown in", "minor units", "minor unit", "単位", "単位:", "単位は", "値は", "金額は", "金額単位:",
    "金額の単位は", "表示単位:", "1 =", "1=", "currency is", "currency:", "通貨は", "通貨:",
)
CUES_AFTER = ("単位", "建て", "表示", "換算", "denominated")
#: Words that take the unit after them away from the amount.
BLOCKERS = ("no", "not in", "not", "was in", "were in", "rounded to", "rounded to whole", "free", "top", "first", "over", "above", "stopped at", "converted from", "instead of", "元は", "formerly in")

#: What a cue beside a phrase adds to its prior.
_CUED = 3.5
#: How far a prior moves a segmentation: it decides between readings of a root, hardly between roots of other lengths.
_PRIOR_SHARE = 0.1
#: A root right after a root says the same once more (`usd cents`), so that the two don't outweigh one longer root.
_SECOND_ROOT = -1.0
_WEIGHT = {"root": 1.0, "prefix": 0.5, "exponent": 0.8, "cue": 0.9, "blocker": 0.9, "number": 0.0, "blank": 0.0, "text": -1.0}
#: What each character that is understood adds, so that one long word outweighs the short ones in it.
_CHARACTER = 1.0


@dataclass(frozen=True)
class Segment:
    kind: str
    text: str
    value: object = None


class _Trie:
    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, text: str, kind: str, value: object) -> None:
        node = self.root
        for ch in text:
            node = node.setdefault(ch, {})
        node.setdefault("", []).append((kind, value))

    def matches(self, s: str, at: int):
        node, i = self.root, at
        while i < len(s) and (node := node.get(s[i])) is not None:
            i += 1
            for kind, value in node.get("", ()):
                yield i, kind, value


@dataclass(frozen=True)
class UnitGrammar:
    """The tries and the field's prior over dimensions; ``other`` is the prior of those not in it."""

    prefixes: dict = field(default_factory=lambda: PREFIXES)
    roots: dict = field(default_factory=lambda: ROOTS)
    exponents: dict = field(default_factory=lambda: EXPONENTS)
    prior: dict = field(default_factory=lambda: MONEY_PRIOR)
    other: float = OTHER_MONEY

    def weight(self, dimension: str) -> float:
        return self.prior.get(dimension, self.other)

    def tries(self) -> _Trie:
        trie = _Trie()
        for kind, words in (("prefix", self.prefixes), ("exponent", self.exponents)):
            for text, value in words.items():
                trie.add(text, kind, value)
        for text, readings in self.roots.items():
            for value in readings:
                trie.add(text, "root", value)
        for text in CUES_BEFORE:
            trie.add(text, "cue", "before")
        for text in CUES_AFTER:
            trie.add(text, "cue", "after")
        for text in BLOCKERS:
            trie.add(text, "blocker", None)
        return trie


def _latin(ch: str) -> bool:
    return "a" <= ch <= "z"


class UnitParser:
    """Reads (dimension, power of ten) out of a currency text or a remark."""

    def __init__(self, grammar: UnitGrammar | None = None) -> None:
        self.grammar = grammar or UnitGrammar()
        self.trie = self.grammar.tries()
        likely = sorted({w for w, readings in self.grammar.roots.items() if any(self.grammar.weight(dim) > -_CUED for dim, _ in readings)}, key=len, reverse=True)
        self.mentions = re.compile("|".join(map(re.escape, likely)))

    @staticmethod
    def clean(text: str) -> str:
        return " ".join(unicodedata.normalize("NFKC", text).lower().split())

    def segments(self, s: str) -> list[Segment]:
        """The best segmentation of ``s``; cost is linear in its length."""
        n = len(s)
        best: list[tuple[float, int, Segment | None, str]] = [(-math.inf, 0, None, "")] * (n + 1)
        best[0] = (0.0, 0, None, "")

        def offer(i: int, j: int, seg: Segment, weight: float) -> None:
            score = best[i][0] + weight
            if score > best[j][0]:
                best[j] = (score, i, seg, best[i][3] if seg.kind == "blank" else seg.kind)

        for i in range(n):
            if best[i][0] == -math.inf:
                continue
            ch = s[i]
            inside = i > 0 and _latin(s[i - 1]) and _latin(ch)
            if ch == " ":
                offer(i, i + 1, Segment("blank", ch), _WEIGHT["blank"])
                continue
            offer(i, i + 1, Segment("text", ch), _WEIGHT["text"])
            if _latin(ch) and not inside:  # a whole word that means nothing here
                j = i + 1
                while j < n and _latin(s[j]):
                    j += 1
                offer(i, j, Segment("text", s[i:j]), _WEIGHT["text"])
            if ch.isdigit() and (i == 0 or not s[i - 1].isdigit()):
                j = i + 1
                while j < n and (s[j].isdigit() or s[j] in ",." and j + 1 < n and s[j + 1].isdigit()):
                    j += 1
                offer(i, j, Segment("number", s[i:j], s[i:j].replace(",", "")), _WEIGHT["number"])
            for j, kind, value in self.trie.matches(s, i):
                if ch.isdigit() and i > 0 and (s[i - 1].isdigit() or s[i - 1] in ",."):
                    continue
                if s[j - 1].isdigit() and j < n and (s[j].isdigit() or s[j] == "," and j + 1 < n and s[j + 1].isdigit()):
                    continue
                after = best[i][2]
                if inside and not (after and after.kind == "prefix"):
                    continue
                if _latin(s[j - 1]) and j < n and _latin(s[j]) and kind != "prefix":
                    continue
                if kind == "prefix" and _latin(s[j - 1]) and j < n and _latin(s[j]) and not any(k == "root" for _, k, _ in self.trie.matches(s, j)):
                    continue
                weight = _SECOND_ROOT if kind == best[i][3] == "root" else _WEIGHT[kind]
                offer(i, j, Segment(kind, s[i:j], value), weight + _CHARACTER * (j - i) + (_PRIOR_SHARE * self.grammar.weight(value[0]) if kind == "root" else 0.0))
        out, at = [], n
        while at > 0:
            _, i, seg, _ = best[at]
            out.append(seg)
            at = i
        return out[::-1]

    def _phrases(self, segs: list[Segment]):
        """Maximal runs of prefix, number, root and exponent that hold a root: (start, end, dim, power, quantity)."""
        i, n = 0, len(segs)
        while i < n:
            if segs[i].kind not in ("prefix", "root", "exponent", "number"):
                i += 1
                continue
            start, dim, power, counted, roots = i, None, 0, False, 0
            while i < n:
                s = segs[i]
                if s.kind == "blank" or s.kind == "text" and s.text in "()・" and roots and i + 1 < n:
                    i += 1
                    continue
                if s.kind == "prefix":
                    power += s.value
                elif s.kind == "exponent":
                    power += s.value
                elif s.kind == "number":
                    if i + 1 < n and segs[i + 1].kind == "blank" and roots:
                        break
                    v = s.value
                    if set(v) <= {"0", "1"} and v[:1] == "1" and v.count("1") == 1 and len(v) > 1:
                        power += len(v) - 1
                    counted = True
                elif s.kind == "root":
                    if roots and (dim != s.value[0]):
                        break
                    dim, power, roots = s.value[0], (power + s.value[1] if not roots else min(power, s.value[1]) if s.value[1] else power), roots + 1
                else:
                    break
                i += 1
            if roots:
                yield start, i, dim, power, counted
            i = max(i, start + 1)

    def currency(self, text: str | None) -> tuple[str, int] | None:
        """The unit a currency field names: its likeliest phrase. None where it names none, unknown where it names what can't be read."""
        text = self.clean(text or "")
        if not any(c.isalnum() or unicodedata.category(c) == "Sc" for c in text) or text in _NOTHING:
            return None
        segs = self.segments(text)
        words = re.findall(r"[^\W\d_]+|[^\w\s]", "".join(x.text if x.kind == "text" else " " for x in segs))
        left = [w for w in words if w not in _FILLERS and (w.isalpha() or unicodedata.category(w) == "Sc")]
        likely = [(self.grammar.weight(dim), -at, dim, power) for at, _, dim, power, _ in self._phrases(segs) if self.grammar.weight(dim) > 0]
        return (UNKNOWN, 0) if left or not likely else max(likely)[2:]

    def remark(self, text: str | None) -> tuple[str, int] | None:
        """The unit a remark states for the amount; None where it states none.

        A phrase counts if a cue touches it and no blocker stands before that cue; a number in
        it makes it a quantity (`10万円超`) unless the cue is an equation (`1 = 1,000 jpy`). Of
        several stated phrases the last one counts.
        """
        if not text:
            return None
        text = self.clean(text)
        if not self.mentions.search(text):  # no root of the field's dimension, so no unit
            return None
        segs, found = self.segments(text), None
        for start, end, dim, power, counted in self._phrases(segs):
            if self.grammar.weight(dim) + _CUED <= 0:  # not even a cue makes it this field's unit
                continue
            lead = [s for s in segs[:start] if s.kind != "blank" and not (s.kind == "text" and s.text in "(:")]
            tail = next((s for s in segs[end:] if s.kind != "blank"), None)
            before, after = lead[-1] if lead else None, tail
            if before and before.kind == "number" and counted is False:
                before = None
            if before and before.kind == "blocker":
                continue
            equation = before is not None and before.kind == "cue" and before.text.endswith("=")
            cued = before is not None and before.kind == "cue" and (before.value == "before" or before.text in CUES_BEFORE)
            trailing = after is not None and after.kind == "cue" and after.text in CUES_AFTER
            if trailing and counted and segs[start].kind == "number" and start + 1 < len(segs) and segs[start + 1].kind == "blank":
                power, counted = self._without_number(segs, start + 1, end)
            if equation or (cued or trailing) and not counted:
                found = (dim, power)
        return found

    def _without_number(self, segs: list[Segment], start: int, end: int) -> tuple[int, bool]:
        for _, _, _, power, counted in self._phrases(segs[start:end]):
            return power, counted
        return 0, True


@lru_cache(maxsize=8)
def _parser(prior: tuple[tuple[str, float], ...]) -> UnitParser:
    return UnitParser(UnitGrammar(prior=dict(prior)))


def unit_of(currency: str | None, remark: str | None, prior: dict[str, float] | None = None) -> tuple[str, int] | None:
    """What the remark states goes before the currency; None where neither names a unit."""
    parser = _parser(tuple(sorted((prior or MONEY_PRIOR).items())))
    return (parser.remark(remark) if remark else None) or (parser.currency(currency) if currency else None)


UNIT_TYPE = T.StructType([T.StructField("dimension", T.StringType()), T.StructField("power", T.IntegerType())])


def unit(currency: Column, remark: Column, prior: dict[str, float] | None = None) -> Column:
    """The unit of each row as struct(dimension, power); single yen where none is named.

    Runs in Arrow batches beside the rows, without a shuffle: only the two texts leave the JVM.
    Every distinct text of a batch is read once, its unit goes to all its rows by position.
    """
    prior = prior or MONEY_PRIOR

    def read(currency: pa.Array, remark: pa.Array) -> pa.Array:
        parser = _parser(tuple(sorted(prior.items())))
        c, r = currency.dictionary_encode(), remark.dictionary_encode()
        named = [parser.currency(t) or ("JPY", 0) for t in c.dictionary.to_pylist()] + [("JPY", 0)]  # the last place is that of a null
        stated = [parser.remark(t) or (None, None) for t in r.dictionary.to_pylist()] + [(None, None)]
        at_c, at_r = pc.fill_null(c.indices, len(named) - 1), pc.fill_null(r.indices, len(stated) - 1)
        parts = [pc.coalesce(pa.array([x[k] for x in stated], t).take(at_r), pa.array([x[k] for x in named], t).take(at_c)) for k, t in ((0, pa.string()), (1, pa.int32()))]
        return pa.StructArray.from_arrays(parts, ["dimension", "power"])

    return F.arrow_udf(read, UNIT_TYPE)(currency.cast("string"), remark.cast("string"))


def unit_code(dimension: Column, power: Column) -> Column:
    """A short name of the unit, `JPY_E8` and the like where it has none of its own."""
    jpy = F.when(power == 0, "JPY").when(power == 3, "JPY_K").when(power == 4, "JPY_10K").when(power == 6, "JPY_M")
    usd = F.when(power == 0, "USD").when(power == -2, "USD_CENT")
    plain = F.when((power == 0) & (dimension != "JPY"), dimension)
    return F.coalesce(F.when(dimension == "JPY", jpy), F.when(dimension == "USD", usd), plain, F.concat(dimension, F.lit("_E"), power.cast("string")))


def rate_table(rates: DataFrame, month: str = "rate_month", currency: str = "currency", rate: str = "jpy_per_unit") -> DataFrame:
    """One rate a month and currency: (rate_month, rate_currency, rate). Of repeated ones the highest counts."""
    from tallyforge.functions.normalize import month_start, word

    return (
        rates.select(month_start(F.col(month)).alias("rate_month"), F.upper(word(F.col(currency))).alias("rate_currency"), F.col(rate).cast("decimal(12,4)").alias("rate"))
        .where(F.col("rate_month").isNotNull() & F.col("rate").isNotNull() & F.col("rate_currency").isNotNull())
        .groupBy("rate_month", "rate_currency")
        .agg(F.max("rate").alias("rate"))
    )


def to_yen(df: DataFrame, rates: DataFrame, amount: str, currency: str, remark: str, month: Column, keep: dict[str, Column], prior: dict[str, float] | None = None) -> DataFrame:
    """Every amount in whole yen.

    The result has the columns named in ``keep`` (expressions over ``df``) and
    ``unit`` (code), ``yen`` (decimal(38,0), rounded half up; null for a null amount, for a month
    without a rate of the currency, for a unit that is named but not known, and for a sum of
    more than 38 digits). Yen needs no rate; any power of ten is taken. ``prior`` weighs the
    dimensions of the field (:data:`MONEY_PRIOR`). Foreign columns of ``df`` are left out, so none
    can clash. The rate table has a row a month and currency; the planner broadcasts it by its size.
    """
    ship(df.sparkSession)
    u = F.col("__unit")
    rows = df.select(*[c.alias(n) for n, c in keep.items()], F.col(amount).cast("bigint").alias("__amount"), month.alias("__month"), unit(F.col(currency), F.col(remark), prior).alias("__unit"))
    table = rate_table(rates).where(F.col("rate_currency") != "JPY")
    rows = rows.join(table, (F.col("__month") == F.col("rate_month")) & (u["dimension"] == F.col("rate_currency")), "left")
    per_unit = F.when(u["dimension"] == "JPY", F.lit(1).cast("decimal(12,4)")).otherwise(F.col("rate"))
    whole, ten = F.col("__amount").cast("decimal(19,0)"), F.concat(F.lit("1e"), u["power"].cast("string"))
    # exact down to millionths: a rate has four places, and 19 digits times 18 are 38 at most
    small = F.try_multiply(whole, (per_unit * ten.try_cast("decimal(20,18)")).cast("decimal(18,10)"))
    large = F.try_multiply(F.try_multiply(whole, per_unit), ten.try_cast("decimal(20,0)"))
    in_yen = [F.round(x, 0).cast("decimal(38,0)") for x in (F.try_multiply(whole, per_unit), small, large)]
    yen = F.when(u["power"] == 0, in_yen[0]).when(u["power"] < 0, in_yen[1]).otherwise(in_yen[2])
    return rows.select(*keep, unit_code(u["dimension"], u["power"]).alias("unit"), yen.alias("yen"))
