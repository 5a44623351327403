"""One consistent form for texts that look the same but are stored with different characters.

Strings and code points that give the same picture are joined to classes by union-find; each
class is represented by its member that is most frequent in the corpus; a multi-pattern automaton
rewrites every other member, the longest first. The edges come from rules over the Unicode
database (canonical, width, font and ligature decompositions, kinds of space, invisible
characters) and from one table of letters that share their shape across scripts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.skew import blocked_pairs, hot_aware_lookup
from loomline.plans.lineage import materialize

# Letters that have one shape in several scripts. Each word is one class.
SAME_SHAPE = """
aа bᏏ cсϲᴄⲥ dԁⅾ eеҽ gɡց hһհᏂ iіⅰᎥ jјϳ lⅼӏ mⅿ nո oοоօᴏⲟ pрⲣ qԛզ sѕꜱ uս vνѵⅴᴠ wԝᴡ xхⅹ yу zᴢ
AΑАᎪꓮ BΒВᏴꓐⲂ CСϹᏟⅭꓚⲤ DᎠⅮꓓ EΕЕᎬꓰ Fꓝ GԌᏀꓖ HΗНᎻꓧⲎ IΙІӀⅠꓲⲒ JЈᎫꓙ KΚКᏦKꓗⲔ LᏞⅬꓡ MΜМϺᎷⅯꓟⲘ NΝꓠⲚ OΟОՕꓳⲞ PΡРᏢꓑⲢ
QԚ RᎡᏒꓣ SЅՏᏚꓢ TΤТᎢꓔⲦ UՍꓴ VѴᏙⅤꓦ WԜᎳꓪ XΧХⅩꓫⲬ YΥҮꓬⲨ ZΖᏃꓜ
ГΓⲄ ПΠ ФΦⲪ əәǝ ɛε æӕ ÆӔ ƆϽꓛ ʒӡ ƷӠ вʙ нʜ мᴍ тᴛ
へヘ ニ二 ロ口 カ力 ハ八 ト卜 エ工 タ夕
-‐‑－﹣ ·‧・∙⋅ ;; ¦￤ ’ʼ ‘ʻ /⁄∕ :∶꞉ !ǃ |ǀ∣ ,‚
"""
# Characters without any picture of their own, wherever they stand.
INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x200B, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0x3164, 0xFEFF, 0xFFA0]
INVISIBLE_RANGES = [(0x180B, 0x180D), (0x200E, 0x200F), (0x202A, 0x202E), (0x2066, 0x206F), (0xFE00, 0xFE0F), (0xE0000, 0xE0FFF)]
#: Compatibility decompositions that keep the picture in one plain font with one width.
SAME_PICTURE = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>", "<small>"}
# Letters whose <compat> decomposition looks different (long s and its ligature, n with apostrophe).
COMPAT_DIFFERS = "ſﬅŉ"

#: No code point from here on has a decomposition or is a space.
LAST_DECOMPOSED = 0x30000

JOINERS = "\u200c\u200d"
PICTOGRAPH = "\u00a9\u00ae\u203c\u2049\u2122\u2139\u2190-\u21ff\u2300-\u23ff\u25a0-\u27bf\u2900-\u297f\u2b00-\u2bff\u3030\u303d\u3297\u3299\U0001f000-\U0001faff"
JOINING_SCRIPTS = "\u0600-\u08ff\u0900-\u0dff\u0f00-\u109f\u1780-\u18af\ua840-\ua87f\ufb50-\ufdff\ufe70-\ufefc"
#: A joiner is seen where it makes one picture of two pictographs, or between letters that join.
UNSEEN_JOINER = re.compile(
    f"(?<![{PICTOGRAPH}{JOINING_SCRIPTS}\ufe0f\U0001f3fb-\U0001f3ff])[{JOINERS}]+|[{JOINERS}]+(?![{PICTOGRAPH}{JOINING_SCRIPTS}])"
)
LINE_END = re.compile("\r\n?")


class Classes:
    """Union-find over strings (a code point is a string of length 1)."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, s: str) -> str:
        self.parent.setdefault(s, s)
        root = s
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[s] != root:
            self.parent[s], s = root, self.parent[s]
        return root

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def members(self) -> list[list[str]]:
        by: dict[str, list[str]] = {}
        for s in sorted(self.parent):
            by.setdefault(self.find(s), []).append(s)
        return [m for m in by.values() if len(m) > 1]


def picture_of(c: str) -> str | None:
    """What ``c`` is drawn like by the Unicode database's own decomposition, if it is drawn like anything else."""
    if c == "\t" or c in COMPAT_DIFFERS:
        return None
    if unicodedata.category(c) == "Zs":
        return " "
    kind, *points = unicodedata.decomposition(c).split() or [""]
    target = "".join(chr(int(p, 16)) for p in points)
    if kind == "<compat>" and all(unicodedata.category(t)[0] == "L" for t in target) or kind == "<compat>" and c in "․‥…":
        return unicodedata.normalize("NFD", target)
    if kind in SAME_PICTURE:
        return unicodedata.normalize("NFD", target)
    return None


def look_alike_classes() -> list[list[str]]:
    """The transitive classes, over decomposed (NFD) text. The members' number is bounded by Unicode, not by data."""
    classes = Classes()
    for c in map(chr, (*range(0xD800), *range(0xE000, LAST_DECOMPOSED))):
        if (like := picture_of(c)) and like != c:
            classes.union(c, like)
    for word in SAME_SHAPE.split():
        first = word[0]
        for c in word[1:]:
            classes.union(first, unicodedata.normalize("NFD", c))
    for c in [*INVISIBLE, *(c for a, b in INVISIBLE_RANGES for c in range(a, b + 1))]:
        classes.union(chr(c), "")
    return classes.members()


def rewriting(classes: list[list[str]], counts: dict[str, int]) -> dict[str, str]:
    """Each member that is not its class's representative, with the representative.

    The most frequent single code point represents a class, of equally frequent ones the lowest;
    a class that has the empty string is invisible and vanishes; a string of several code points
    (a ligature's letters) wins over any one code point, for its letters have classes themselves.
    """
    out: dict[str, str] = {}
    for members in classes:
        if "" in members:
            best = ""
        elif many := [m for m in members if len(m) > 1]:
            best = max(many, key=len)
        else:
            best = min(members, key=lambda m: (-counts.get(m, 0), m))
        out |= {m: best for m in members if m != best}
    # A representative of several code points is written in the representatives of its own.
    return {m: "".join(out.get(c, c) for c in r) if len(r) > 1 else r for m, r in out.items()}


class Rewriter:
    """Greedy rewriting, leftmost and longest first, by an Aho-Corasick automaton.

    Where no member of several code points can begin, the automaton never leaves its first level,
    and a table of code points does the same; a text of fixed code points is its own form.
    """

    def __init__(self, rules: dict[str, str]):
        self.automaton = ahocorasick.Automaton()
        for member, best in rules.items():
            if member:
                self.automaton.add_word(member, (len(member), best))
        self.automaton.make_automaton()
        self.single = {ord(m): best for m, best in rules.items() if len(m) == 1}
        self.starts, longer = (np.zeros(0x110000, bool) for _ in range(2))
        self.starts[[ord(m[0]) for m in rules if m]] = True
        longer[[ord(m[0]) for m in rules if len(m) > 1]] = True
        self.longer = "".join(map(chr, np.flatnonzero(longer)))
        self.begins_longer = re.compile("[" + re.escape(self.longer) + "]") if self.longer else None
        self.fixed = self._fixed()

    def _fixed(self) -> np.ndarray:
        """The code points that keep their form between any neighbours: starters that no rule touches and that nothing composes with."""
        fixed = np.ones(0x110000, bool)
        fixed[0xD800:0xE000] = False
        followers = set()
        for p in range(0x110000):
            c = chr(p)
            if 0xD800 <= p < 0xE000 or p >= LAST_DECOMPOSED and not unicodedata.combining(c) and not self.starts[p]:
                continue
            whole = unicodedata.normalize("NFD", c)
            if len(whole) > 1:
                followers.update(whole[1:])
            if unicodedata.combining(c) or any(self.starts[ord(x)] for x in whole) or unicodedata.normalize("NFC", c) != c:
                fixed[p] = False
        fixed[[ord(c) for c in followers]] = False
        fixed[0x1100:0x1200] = False  # Hangul letters compose by arithmetic
        fixed[[ord(c) for c in JOINERS + "\r"]] = False
        return fixed

    def rewrite(self, text: str) -> str:
        out, at = [], 0
        for end, (length, best) in self.automaton.iter_long(text):
            start = end + 1 - length
            out += (text[at:start], best)
            at = end + 1
        return "".join(out) + text[at:] if at else text

    def canonical(self, text: str) -> str:
        """The consistent form. Line ends are LF; tabs, blank lines and runs of spaces stay, for they are seen."""
        if "\r" in text:
            text = LINE_END.sub("\n", text)
        if text.isascii():
            return text
        if "\u200d" in text or "\u200c" in text:
            text = UNSEEN_JOINER.sub("", text)
        text = unicodedata.normalize("NFD", text)
        text = self.rewrite(text) if self.begins_longer and self.begins_longer.search(text) else text.translate(self.single)
        # Marks may stand in another order once what stood between them is gone; composing puts them in order first.
        return unicodedata.normalize("NFC", text)

    def forms(self, texts: list[str | None], block: int = 256) -> list[str | None]:
        """The forms of many texts; those of fixed code points are found by one look-up a block and stay as they are."""
        out: list[str | None] = list(texts)
        for start in range(0, len(texts), block):
            some = [(i, t) for i, t in enumerate(texts[start : start + block], start) if t and (not t.isascii() or "\r" in t)]
            if not some:
                continue
            points = np.frombuffer("".join(t for _, t in some).encode("utf-32-le"), np.uint32)
            begins = np.cumsum([0, *(len(t) for _, t in some[:-1])])
            touched = np.logical_or.reduceat(~self.fixed[points], begins)
            for (i, t), here in zip(some, touched):
                if here:
                    out[i] = self.canonical(t)
        return out


def member_counts(texts: DataFrame, classes: list[list[str]]) -> dict[str, int]:
    """How often each single-code-point member occurs in all texts: one pass, a bounded result."""
    members = np.array(sorted({ord(m) for c in classes for m in c if len(m) == 1}), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.zeros(0x110000, np.int32)
        place[members] = np.arange(1, len(members) + 1)
        sums = np.zeros(len(members) + 1, np.int64)
        for batch in batches:
            texts = batch.column(0).drop_null().to_pylist()
            for start in range(0, len(texts), 256):
                points = np.frombuffer("".join(texts[start : start + 256]).encode("utf-32-le"), np.uint32)
                sums += np.bincount(place[points], minlength=len(sums))
        seen = np.flatnonzero(sums[1:])
        yield pa.RecordBatch.from_arrays([pa.array(members[seen]), pa.array(sums[1:][seen])], ["point", "n"])

    found = texts.mapInArrow(run, "point bigint, n bigint").groupBy("point").agg(F.sum("n").alias("n"))
    return {chr(r["point"]): r["n"] for r in found.collect()}


def canonical_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, canonical): every row's text with its consistent form; null gives null, empty gives empty.

    Texts with equal forms look the same, and different-looking texts keep different forms.
    """
    source = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text"))
    classes = look_alike_classes()
    rules = docs.sparkSession.sparkContext.broadcast(rewriting(classes, member_counts(source.select("text"), classes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewriter = Rewriter(rules.value)
        for batch in batches:
            forms = rewriter.forms(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, pa.string())], ["_key", "text", "canonical"])

    kind = source.schema["_key"].dataType.simpleString()
    return source.mapInArrow(run, f"_key {kind}, text string, canonical string").withColumnRenamed("_key", key)


def look_alike_members(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, look, stored) of the rows that look like another row stored differently, as 128-bit digests.

    Null, empty and blank texts take no part. Materialised: two narrow columns a row.
    """
    forms = canonical_texts(docs, key, text).where("canonical rlike '[^\\\\s\\u00a0]'")
    narrow = materialize(forms.select(key, F.unhex(F.md5("canonical")).alias("look"), F.unhex(F.md5("text")).alias("stored")))
    # Minimum and maximum of the stored forms are aggregated before the shuffle, whatever a group's size.
    mixed = narrow.groupBy("look").agg(F.min("stored").alias("a"), F.max("stored").alias("b"), F.count("*").alias("n")).where("a <> b")
    return hot_aware_lookup(narrow, mixed.select("look", "n"), "look", "n")


def look_alike_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(<key>_a, <key>_b), a < b: rows that look the same but are not equal as stored.

    All such pairs, also of repeated texts; a key that comes twice is one document per row.
    """
    members = look_alike_members(docs, key, text)
    different = F.col("stored_a") != F.col("stored_b")
    return blocked_pairs(members, "look", key, where=different).select(f"{key}_a", f"{key}_b").distinct()


def look_alike_classes_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, n_forms, n_rows): one row per document; class_id is the smallest key with the same look.

    A document that looks like no other is a class of its own. Null and blank texts take no part.
    """
    forms = canonical_texts(docs, key, text).where("canonical rlike '[^\\\\s\\u00a0]'")
    narrow = materialize(forms.select(key, F.unhex(F.md5("canonical")).alias("look"), F.unhex(F.md5("text")).alias("stored")))
    each = narrow.groupBy("look", "stored").agg(F.min(key).alias("k"), F.count("*").alias("n"))
    classes = each.groupBy("look").agg(F.min("k").alias("class_id"), F.count("*").alias("n_forms"), F.sum("n").alias("n_rows"), F.sum("n").alias("_w"))
    return hot_aware_lookup(narrow.select(key, "look"), classes, "look", "_w").drop("look")
