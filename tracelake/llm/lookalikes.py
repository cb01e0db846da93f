"""One consistent form for texts that look the same.

Method. (1) Compatibility normalization, character by character, with canonical composition at the end; superscripts,
subscripts, circled forms and fractions stay, since they are visibly different. (2) Ignorable characters (format
controls, variation selectors, soft hyphens, fillers) are deleted; every kind of space becomes one space; hyphens and CJK radicals become
their common form. (3) Tokens of alphabetic letters become, decomposed into letters and accents, lattices of look-alike
letters, and a Viterbi search takes the way through the lattice with the best script-consistent character bigram score.
The bigram counts are taken over all documents; of a class only its first letter and letters that occur there are offered.

Look-alikes are the short table below and the published confusables data (Unicode Technical Standard 39) as the ICU library
ships them with Spark: letters of one skeleton form a class. A stroke that stands for both a capital I and a small l is
in neither class for good: its lattice offers both readings, the less likely by its case at ``DOUBT``, and the search decides.
Digits are never letters, and ``rn`` is not ``m``: these are visible differences.

Why the result is one form. Apart from such strokes a token's lattice depends only on the look-alike class of each character, so
texts that look the same have the same lattices, hence the same best way. Two lattices differ in the class at some position, and
classes share no letters, so texts that look different never meet. A stroke read as I meets the texts that have an I there.

Scale. Counting sends one small table of bigrams (bounded by the letters of three scripts) to the driver. Finding pairs
shuffles two hashes per text, never a text; groups of copies are folded into one row per distinct text first.

Defined results. NULL texts have no form and are in no pair. The empty text has the empty form. Byte-identical texts
are no pair. Repeated ids are treated as further rows. Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialise

# Look-alike classes of letters; the first letter of each is Latin.
LOOKALIKES = """
aаα cсϲ eе iіι jјϳ oоοօ pрρ sѕ xхχ yуγ hһ dԁ qԛ wԝ vνѵ uυ nո lӏ kκ
AАΑ BВΒ CСϹ EЕΕ FϜ HНΗ IІΙӀ JЈ KКΚ MМΜ NΝ OОΟՕ PРΡ SЅ TТΤ XХΧ YҮΥ ZΖ GԌ QԚ WԜ VѴ
""".split()

# Scripts whose letters may be taken for one another, as they begin the characters' names.
ALPHABETS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE", "COPTIC", "LISU", "GEORGIAN")

# Hyphens that look like the ASCII one.
HYPHENS = "‐‑⁃﹣－­"[:5]

# CJK radicals without a compatibility mapping, each followed by the ideograph it looks like.
RADICALS = """
⺀冫 ⺁厂 ⺄乙 ⺅亻 ⺆冂 ⺈刀 ⺉刂 ⺋卩 ⺎兀 ⺏尣 ⺐尢 ⺒巳 ⺓幺 ⺔彑 ⺖忄 ⺘扌 ⺙攵 ⺛旡 ⺝月 ⺟母 ⺠民 ⺡氵 ⺣灬 ⺤爫 ⺦丬 ⺨犭 ⺩王 ⺪疋 ⺫目 ⺬示 ⺭礻 ⺮竹 ⺯糹 ⺰纟 ⺱罓 ⺲罒 ⺳网 ⺵网
⺷羊 ⺸羊 ⺹耂 ⺺肀 ⺼月 ⺽臼 ⺾艹 ⻀艹 ⻁虎 ⻂衤 ⻃覀 ⻄西 ⻅见 ⻆角 ⻈讠 ⻉贝 ⻊足 ⻋车 ⻌辶 ⻍辶 ⻎辶 ⻏阝 ⻐钅 ⻑長 ⻒镸 ⻓长 ⻔门 ⻕阝 ⻖阝 ⻗雨 ⻘青 ⻙韦 ⻚页 ⻛风
⻜飞 ⻝食 ⻟食 ⻠饣 ⻡首 ⻢马 ⻣骨 ⻤鬼 ⻥鱼 ⻦鸟 ⻧卤 ⻨麦 ⻩黄 ⻪黾 ⻫斉 ⻬齐 ⻭歯 ⻮齿 ⻯竜 ⻰龙 ⻱龜 ⻲亀
""".split()

KEPT_TAGS = {"<super>", "<sub>", "<circle>", "<fraction>", "<square>"}
IGNORABLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￹-￻\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]")
SPACES = re.compile("[   -     　\t\v\f\x85]")
LETTER_TOP = 0x2000
SCRIPT_SWITCH, SMOOTH, DOUBT = 9.0, 0.5, 4.0

_RADICAL = {ord(p[0]): p[1] for p in RADICALS} | {ord(c): "-" for c in HYPHENS}


#: Where characters live that change: compatibility forms, controls, radicals, mathematical letters, tags.
RANGES = [(0x09, 0x3400), (0xA000, 0xA4D0), (0xF900, 0x10000), (0x1BCA0, 0x1BCA4), (0x1D000, 0x1F200), (0x2F800, 0x2FA20), (0xE0000, 0xE1000)]


def _changed(c: str) -> str:
    """The form of one character after compatibility normalization, deletion and unification."""
    if IGNORABLE.match(c):
        return ""
    if SPACES.match(c):
        return " "
    if ord(c) in _RADICAL:
        return _RADICAL[ord(c)]
    tag = unicodedata.decomposition(c).split(" ", 1)[0]
    form = c if tag in KEPT_TAGS else unicodedata.normalize("NFKC", c)
    return "".join(_RADICAL.get(ord(x), x) for x in form)


def _class_of(points: list[int]) -> str:
    """A character class of runs of code points."""
    runs: list[list[int]] = []
    for p in points:
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]"


_CHANGES = {chr(p): form for lo, hi in RANGES for p in range(lo, hi) if not 0xD800 <= p < 0xE000 and (form := _changed(chr(p))) != chr(p)}
_COMMON = [(c, _CHANGES.pop(c)) for c in "，：（）；？！％" if c in _CHANGES]  # so frequent that a plain replacement pays
_ODD = re.compile(_class_of(sorted(p for p in map(ord, _CHANGES) if p < 0x10000)))
_FAR = re.compile("[\U00010000-\U0010ffff]")


def prepare(text: str) -> str:
    """Steps (1) and (2); the letters' scripts are still as they were."""
    if not text.isascii():
        for c, form in _COMMON:
            text = text.replace(c, form)
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    text = _ODD.sub(lambda m: _CHANGES[m[0]], text)
    if _FAR.search(text):
        text = _FAR.sub(lambda m: _CHANGES.get(m[0], m[0]), text)
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def script(c: str) -> int:
    """A number for the script of a letter; -1 for accents, which go with every script."""
    p = ord(c)
    if p < 0x300:
        return 0
    return -1 if p < 0x370 else 1 if p <= 0x3FF else 2 if p <= 0x52F else 3 if p <= 0x587 else 0 if 0x1E00 <= p < 0x1F00 else 4 + (p >> 8)


def published(spark: SparkSession) -> list[str]:
    """Letters of one skeleton in the published confusables data; nothing where the library isn't there."""
    kind = getattr(spark.sparkContext._jvm.com.ibm.icu.text, "SpoofChecker", None)
    if not hasattr(kind, "Builder"):
        return []
    letters = [c for p in range(0x41, 0x1F000) if unicodedata.category(c := chr(p))[0] == "L" and unicodedata.name(c, "").startswith(ALPHABETS) and unicodedata.normalize("NFKD", c) == c]
    skeletons = kind.Builder().build().getSkeleton("\n".join(letters)).split("\n")
    groups: dict[str, str] = {}
    for c, skeleton in zip(letters, skeletons):
        groups[skeleton] = groups.get(skeleton, "") + c
    return [g for g in groups.values() if len(g) > 1]


@dataclass(frozen=True)
class Letters:
    """Look-alike classes, and the letters that two of them claim: {letter: (class by its case, other class)}."""

    classes: tuple[str, ...]
    doubtful: dict[str, tuple[str, str]]

    @staticmethod
    def of(groups: list[str]) -> Letters:
        """The fixed classes, extended by groups of letters of one skeleton."""
        at = {c: k for k, cls in enumerate(LOOKALIKES) for c in cls}
        classes, doubt = list(LOOKALIKES), {}
        for group in groups:
            held = sorted({at[c] for c in group if c in at and c.isascii()}) or sorted({at[c] for c in group if c in at})
            new = "".join(c for c in group if c not in at)
            if len(held) > 1:  # a capital and a small letter of one shape
                upper, lower = sorted(held, key=lambda k: not classes[k][0].isupper())[:2]
                doubt.update({c: (upper, lower) if c.isupper() else (lower, upper) for c in group if not c.isascii()})
            elif held:
                classes[held[0]] += new
                at.update(dict.fromkeys(new, held[0]))
            elif len(new) > 1:
                classes.append(new)
                at.update(dict.fromkeys(new, len(classes) - 1))
        return Letters(tuple(classes), {c: (classes[k], classes[m]) for c, (k, m) in doubt.items()})


class Lattice:
    """Viterbi over look-alike letters with bigram scores ``{(a << 16) | b: count}``; 0 stands for a token's edge."""

    def __init__(self, counts: dict[int, int], letters: Letters):
        self.counts = counts
        self.total: dict[int, int] = {}
        for k, n in counts.items():
            self.total[k >> 16] = self.total.get(k >> 16, 0) + n
        occurs = lambda cls: cls[0] + "".join(c for c in cls[1:] if ord(c) in self.total)
        skeleton = {ord(c): cls[0] for cls in letters.classes for c in cls}
        self.ways = {cls[0]: [(c, 0.0) for c in occurs(cls)] for cls in letters.classes}
        signs: dict[tuple[str, str], str] = {}
        for c, (likely, other) in letters.doubtful.items():
            sign = signs.setdefault((likely, other), chr(0xE000 + len(signs)))  # no token holds such a character
            skeleton[ord(c)] = sign
            self.ways[sign] = [(d, 0.0) for d in occurs(likely)] + [(d, DOUBT) for d in occurs(other)]
        self.skeleton = skeleton
        self.run = re.compile("[" + "".join(self.ways) + "]+")
        rare = [p for p in skeleton if p >= LETTER_TOP or 0x588 <= p < 0x1E00]
        self.token = re.compile("(?:[A-Za-zÀ-ɏɐ-ʯ\u0300-\u036fͰ-ϿЀ-ԯԱ-ևḀ-ỿ]" + (f"|{_class_of(sorted(rare))}" if rare else "") + ")+")
        self.scores: dict[int, float] = {}
        self.memo: dict[tuple[str, str, str], str] = {}
        self.seen: set[str] = set()
        self.altered: dict[str, str] = {}

    def score(self, a: int, b: int) -> float:
        known = self.scores.get((a << 16) | b)
        if known is None:
            known = math.log((self.counts.get((a << 16) | b, 0) + SMOOTH) / (self.total.get(a, 0) + SMOOTH * 400))
            one, two = (script(chr(x)) if x else -1 for x in (a, b))
            if one != two and one >= 0 <= two:
                known -= SCRIPT_SWITCH
            self.scores[(a << 16) | b] = known
        return known

    def best(self, token: str) -> str:
        """Letters without look-alikes are fixed points of every way, so each run between them is searched by itself."""
        if token.isascii():
            return self.run.sub(self._run, token.translate(self.skeleton))
        return unicodedata.normalize("NFC", self.run.sub(self._run, unicodedata.normalize("NFD", token).translate(self.skeleton)))

    def _run(self, m: re.Match) -> str:
        key, a, b = m.string, m.start(), m.end()
        at = (key[a - 1 : a], m[0], key[b : b + 1])
        known = self.memo.get(at)
        if known is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            known = self.memo[at] = self._search(*at)
        return known

    def _search(self, left: str, run: str, right: str) -> str:
        """Viterbi from the fixed letter (or edge) before the run to the one after it; ties go to the earlier letter of a class."""
        score = self.score
        ways = [(ord(left) if left else 0, 0.0, "")]
        for c in run:
            nxt = []
            for d, doubt in self.ways[c]:
                q, most, way = ord(d), -math.inf, ""
                for p, s, w in ways:
                    if (v := s + score(p, q)) > most:
                        most, way = v, w
                nxt.append((q, most - doubt, way + d))
            ways = nxt
        end = ord(right) if right else 0
        return max(ways, key=lambda w: w[1] + score(w[0], end))[2]

    def form(self, text: str) -> str:
        """Most texts have no token that changes, which is settled by set operations over their distinct tokens."""
        text = prepare(text)
        tokens = set(self.token.findall(text))
        fresh = tokens - self.seen
        if fresh:
            if len(self.seen) > 1_000_000:
                self.seen, self.altered, fresh = set(), {}, tokens
            self.altered.update((t, b) for t in fresh if (b := self.best(t)) != t)
            self.seen |= fresh
        if self.altered.keys().isdisjoint(tokens):
            return text
        return self.token.sub(lambda m: self.altered.get(m[0], m[0]), text)


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of adjacent letters (an edge is 0), one table per partition: letters below LETTER_TOP in one array."""
    counts = np.zeros(0, dtype=np.int64)
    keys = np.zeros(0, dtype=np.int64)
    for batch in batches:
        joined = unicodedata.normalize("NFD", "\n".join(prepare(t) for t in batch.column(0).to_pylist() if t is not None))
        for k in range(0, len(joined) + 1, 1 << 22):
            p = np.frombuffer(("\n" + joined[k : k + (1 << 22)] + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
            letter = ((p >= 65) & (p <= 90)) | ((p >= 97) & (p <= 122)) | ((p >= 0xC0) & (p < 0x588) & (p != 0xD7) & (p != 0xF7)) | ((p >= 0x1E00) & (p < 0x1F00))
            p = np.where(letter, p, 0)
            pair = (p[:-1] << 16) | p[1:]
            k2, n2 = np.unique(pair[pair != 0], return_counts=True)
            merged = np.concatenate([keys, k2])
            keys, where = np.unique(merged, return_inverse=True)
            counts = np.bincount(where, weights=np.concatenate([counts, n2])).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])


def bigram_counts(docs: DataFrame, text: str = "text") -> dict[int, int]:
    """Letter bigrams of all documents. At most (letters of three scripts)^2 rows reach the driver."""
    counted = docs.select(text).mapInArrow(_bigrams, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    return {r.pair: r.n for r in counted.collect()}


def _model(docs: DataFrame, text: str):
    """Bigram counts and classes for the workers; both are bounded by the letters of the alphabets."""
    spark = docs.sparkSession
    return spark.sparkContext.broadcast((bigram_counts(docs, text), Letters.of(published(spark))))


def visual_forms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form): the consistent form of every text."""
    model = _model(docs, text)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(*model.value)
        for part in parts:
            yield pd.DataFrame({"key": part["key"], "form": part["text"].map(lattice.form, na_action="ignore")})

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, "key bigint, form string")


def form_keys(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form, raw): 128-bit hashes of each text's form and of the text itself."""
    model = _model(docs, text)
    schema = pa.schema([("key", pa.int64()), ("form", pa.binary()), ("raw", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*model.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                texts = part.column(1).to_pylist()
                form = [xxhash.xxh3_128_digest(lattice.form(t).encode("utf-8", "surrogatepass")) for t in texts]
                raw = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(form, pa.binary()), pa.array(raw, pa.binary())], schema=schema)

    return docs.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, "key bigint, form binary, raw binary")


def lookalike_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b): rows whose texts are different strings with one form, least id first.

    Spellings are paired before rows: a spelling stands for all its copies, so a group of exact copies is never compared
    with itself, and only the pairs of the result are expanded.
    """
    keys = materialise(form_keys(docs, key, text), "forms")
    spellings = keys.select("form", "raw").distinct()
    shared = spellings.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    spellings = materialise(spellings.join(shared, "form", "left_semi"), "spellings")
    pairs = spellings.select("form", F.col("raw").alias("raw_a")).join(spellings.select("form", F.col("raw").alias("raw_b")), "form").where("raw_a < raw_b").select("raw_a", "raw_b")
    rows = keys.join(spellings.select("raw"), "raw", "left_semi").select("raw", "key").distinct()
    a, b = rows.select(F.col("raw").alias("raw_a"), F.col("key").alias("x")), rows.select(F.col("raw").alias("raw_b"), F.col("key").alias("y"))
    out = pairs.join(a, "raw_a").join(b, "raw_b").where("x != y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
    return out.distinct()
