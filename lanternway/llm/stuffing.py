"""Keyword-stuffed and link-list pages: repeated substrings against clause structure.

For each page the suffixes of its text are numbered by how they begin, which says which characters lie in a
substring that the page repeats, and so which words repeats cover. A segment that has the makings of a clause
(words that belong to sentences among others, or the grammar of its script) is writing however often it recurs; one
without them whose words repeats cover, or that is a bare link, is stuffing. A page is a case if stuffing makes up most
of its own content. Which words belong to sentences is known for some languages and learnt from the pages for all.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternway.runtime import Scratch

#: Fixed lists: frequent function words by language; fewer than fifty each.
FUNCTION_WORDS = {
    "en": "the a an of to and in is was that it for on with as by at from which were are be this had has have not but they their we our you your she he his her or who when where what so until because although though after before nobody every some most despite than then there no if yet",
    "de": "der die das den dem des ein eine einen einem einer eines und ist war nicht mit von zu zum zur im in auf für an bei aus nach es sich so wie dass wir sie er ihr uns unser unsere bis seit doch wenn was wer als hat haben wurde wird sind trotz obwohl weil bevor während durch über hinter",
    "fr": "le la les l un une des du de d et est était à au aux en dans pour par sur avec que qu qui ce cette ces il elle on nous vous ils se s n ne pas plus mais ou où si jusqu jusque bien malgré depuis sans a ont été sont notre nos selon vers derrière cela",
    "es": "el la los las un una unos de del y es fue era a al en para por con que se no lo su sus este esta nos nuestro nuestra hasta desde aunque pese si o pero como muy más qué cuando tras sin ha han son según hacia cada nadie nunca eso",
    "ru": "про или и в во на не что с со по за к ко из у о об от до для как это был была было были он она они мы вы но а же хотя если когда несмотря без при так нас нам его её их все всё ещё уже под над бы никто каждый которого где тоже",
    "hi": "के का की में से है हैं था थी थे पर को ने और कि यह वह इस उस एक भी तो ही नहीं हो गया गई गए हम हमने जो या लिए साथ तक बाद कर अब रहा रही कुछ सब जब क्या",
}
FUNCTION = frozenset(w for words in FUNCTION_WORDS.values() for w in words.split())
#: Words that mark consent notices and page furniture; fixed list.
NOTICE = re.compile(r"cookie|куки|クッキー|कुकीज़|©|copyright|all rights reserved", re.I)
#: Links, and hosts by their form: labels joined by dots, the last alphabetic and in one case; "end.Then" is where a sentence ends.
LINK = re.compile(r"(?i:https?://\S+|\bwww\.\S+)|(?<![\w-])(?:[\w-]+\.)+(?:[a-zа-яё]{2,}|[A-Z]{2,})(?![\w-])\S*")
ARROWS = frozenset("»›→⇒>")
ARROW = re.compile(r"^\s*[»›→⇒]|[»›→⇒]\s*$|>>\s*$|^\s*>>")
TAGS = re.compile(r"(?:#[^\W\d]\w*\s+){2}#[^\W\d]")
WORD = re.compile(r"[぀-ゟ]+|[゠-ヿ]+|[一-鿿々]+|(?:(?![぀-ヿ一-鿿々])[\wऀ-ॿ'’�])+")
SEGMENT = re.compile(r"[^\n]+")
SENTENCE = re.compile(r"(?<=[.!?;])\s+|(?<=[。！？।])\s*")
ENDED = re.compile(r"[.!?।。！？…][\"'»”)\]]*\s*$")
HIRAGANA = re.compile(r"[぀-ゟ]")
DIGITS = re.compile(r"\d+")
LEET = str.maketrans("013457", "oleast")
LEET_WORD = re.compile(r"^(?=.*[a-z])(?=.*[013457])[a-z013457]+$")

#: A repeat counts from so many occurrences in the page and from so many characters.
TIMES, DEPTH = 3, 6
#: Share of a clause-free segment's letters that repeats must cover, share of a page that must be stuffing.
COVERED, MOST = 0.45, 0.5
#: Letters of stuffing below which a page is too short to be a case (an error message said thrice).
LEAST = 100
#: A clause has at least so many words, so many function words, and such a share of them.
CLAUSE_WORDS, CLAUSE_FUNCTION, CLAUSE_SHARE = 5, 2, 0.2
#: The share that is enough where more different function words are found, as in text without punctuation.
LOOSE_SHARE = 0.1
#: A function word this frequent in a page and always followed by the same word is part of a keyword.
BOUND_TIMES = 6
#: Share and kinds of function words, bound or not, that make a clause all the same.
BOUND_SHARE, BOUND_KINDS = 0.35, 4
#: In a page of which more than this share is unreadable, repeats must cover so much instead.
UNREADABLE, COVERED_UNREADABLE = 0.05, 0.85
#: A reading of the body of an unreadable page must fit so much of what is not ASCII.
FITS = 0.5


def _often(text: str, depth: int, times: int) -> np.ndarray:
    """Where substrings of ``depth`` characters begin that the text holds ``times`` times.

    They are numbered exactly by their characters where these are few enough for that, else ranked by their first 1, 2, 4, ..
    characters, as suffixes are for a suffix array, up to ``depth``: those of equal rank share that many characters.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes) - depth + 1
    if n < times:
        return np.empty(0, np.int64)
    number = codes == ord("#")
    used = np.bincount(codes) > 0
    kinds = int(np.count_nonzero(used))
    if times > 1 and kinds**depth < 2**63:
        rank = (np.cumsum(used) - 1)[codes]
        key = rank[:n].copy()
        for k in range(1, depth):
            key *= kinds
            key += rank[k : n + k]
        begins = np.flatnonzero(np.convolve(number, np.ones(depth, np.int64))[depth - 1 : depth - 1 + n] == 0) if number.any() else np.arange(n)
        key = key[begins]
        ordered = np.sort(key)
        repeats = ordered[times - 1 :][ordered[times - 1 :] == ordered[: len(ordered) - times + 1]]
        if not len(repeats):
            return repeats
        at = np.searchsorted(repeats, key)
        return begins[repeats[np.minimum(at, len(repeats) - 1)] == key]
    codes = codes.astype(np.int64)
    codes[number] = -1 - np.arange(np.count_nonzero(number))
    _, rank = np.unique(codes, return_inverse=True)
    known = 1
    while known < depth:
        step = min(known, depth - known)
        pairs = rank[:-step] * (len(codes) + 1) + rank[step:]
        order = np.argsort(pairs, kind="stable")
        new = np.r_[True, np.diff(pairs[order]) > 0]
        rank = np.empty(len(pairs), np.int64)
        rank[order] = np.cumsum(new) - 1
        known += step
    return np.flatnonzero(np.bincount(rank)[rank] >= times)


def repeated(text: str, depth: int, times: int) -> np.ndarray:
    """Which characters lie in a substring of ``depth`` characters and more that the text holds ``times`` times.

    A longer repeat consists of repeats of ``depth`` characters, so these are enough.
    Numbers ("#") differ from each other, as repeats of columns of figures say nothing of the words beside them.
    """
    n = len(text)
    often = _often(text, depth, times)
    out = np.zeros(n + depth + 1, np.int64)
    out[often] += 1
    out[often + depth] -= 1
    return np.cumsum(out)[:n] > 0


#: Wrong and right readings of bytes, tried in this order; fixed values.
READINGS = (("cp1252", "utf-8"), ("cp1251", "utf-8"), ("latin-1", "utf-8"), ("koi8-r", "utf-8"), ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1252", "koi8-r"), ("latin-1", "koi8-r"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "cp1252"), ("cp1251", "latin-1"))


#: The same for Japanese, told by its kana.
KANA_READINGS = (("cp932", "euc_jp"), ("cp1252", "euc_jp"), ("cp1252", "cp932"), ("latin-1", "euc_jp"), ("latin-1", "cp932"), ("cp1251", "euc_jp"), ("cp1251", "cp932"))


def _known(text: str, known: frozenset) -> int:
    return sum(w in known for w in text.lower().split())


def repaired(text: str, known: frozenset = FUNCTION) -> str:
    """Text decoded from the wrong charset, put right if one reading of READINGS has far more function words."""
    if text.isascii():
        return text
    words = text.count(" ") + 1
    before = _known(text, known)
    if before >= 0.15 * words or HIRAGANA.search(text):
        return text
    best, most = text, 2 * before + 3
    for wrong, right in READINGS:
        if right == "utf-8":  # a few bytes may have been lost on the way; no other text comes through by chance
            kept = text.encode(wrong, "ignore")
            t = kept.decode(right, "replace")
            if len(kept) > 0.9 * len(text) and len(t) < 0.98 * len(kept) and t.count("\ufffd") < 0.2 * len(t):
                return t
            continue
        try:
            t = text.encode(wrong).decode(right)
        except (UnicodeDecodeError, UnicodeEncodeError):
            continue
        n = _known(t, known)
        if n > most:
            best, most = t, n
    if best is text:
        for wrong, right in KANA_READINGS:
            kept = text.encode(wrong, "ignore")
            t = kept.decode(right, "replace")
            if 2 * len(kept) > len(text) and len(HIRAGANA.findall(t)) > 0.15 * len(t) and t.count("\ufffd") < 0.2 * len(t):
                return t
    return best


#: Charsets of a body by what their text looks like where it is read rightly; fixed lists. Kanji fit less well than kana, since much else reads as kanji.
CYRILLIC_WORD = re.compile(r"(?<![A-Za-z])[А-ЯЁ]?[а-яё]+(?![A-Za-z])")
KANA_LIKE, KANJI = re.compile(r"[\u3000-\u30ff\uff01-\uff60]"), re.compile(r"[一-鿿]")
ACCENTED = re.compile(r"(?<=[A-Za-z])[À-ÿŒœŠšŽž]|[À-ÿŒœŠšŽž](?=[A-Za-z])")
OTHER_THAN_ASCII = re.compile(r"[^\x00-\x7f]")
CHARSETS = ("utf-8", "cp1251", "koi8-r", "euc_jp", "cp932", "cp1252")
UNSEEN = re.compile(r"<!--.*?-->|<(head|script|style|nav|footer)\b.*?</\1\s*>", re.I | re.S)
INLINE = re.compile(r"</?(?:a|abbr|b|em|font|i|q|s|small|span|strong|sub|sup|u)\b[^>]*>", re.I)
TAG = re.compile(r"<[/!?a-z][^>]*>", re.I)


def body_text(raw: bytes) -> str | None:
    """The text of a response body in the charset that fits it best, whatever was declared; None if none fits."""
    best, most = None, FITS
    for charset in CHARSETS[:1] if b"\xef\xbf\xbd" in raw else CHARSETS:  # what was lost before the body was stored is UTF-8
        t = TAG.sub("\n", INLINE.sub("", UNSEEN.sub("\n", raw.decode(charset, "replace"))))
        high = len(OTHER_THAN_ASCII.findall(t))
        if t.count("\ufffd") > UNREADABLE * len(t):
            continue
        if charset == "utf-8":
            fit = high - 10 * t.count("\ufffd")
        elif charset in ("cp1251", "koi8-r"):
            fit = sum(map(len, CYRILLIC_WORD.findall(t)))
        elif charset == "cp1252":
            fit = len(ACCENTED.findall(t))
        else:
            fit = len(KANA_LIKE.findall(t)) + 0.7 * len(KANJI.findall(t))
        if high and fit > most * high:
            best, most = t, fit / high
    return best


def _plain(word: str) -> str:
    w = word.lower()
    if w.isalpha():
        return w
    if LEET_WORD.match(w) and not w.isdigit():
        return w.translate(LEET) if sum(ch.isdigit() for ch in w) * 2 <= len(w) and not w[-2:].isdigit() else DIGITS.sub("#", w)
    return DIGITS.sub("#", w)


class _Spelled(dict):
    """The number of each spelling; words of one plain form share it."""

    def __init__(self, ids: dict[str, int]):
        self.ids = ids

    def __missing__(self, word: str) -> int:
        k = self[word] = self.ids.setdefault(_plain(word), len(self.ids))
        return k


def has_clause(raw: str, words: list[int], free: list[bool], function: list[bool], ended: bool = False) -> bool:
    """Whether a segment reads as (part of) a sentence rather than as a list item.

    free says of each word number whether it is a function word that the page does not bind: one that
    is always followed by the same word ("pas" in "pas cher") is part of a keyword. function says it of
    bound ones too, which count where they are many and different, as in the lines of a song.
    """
    kana = len(HIRAGANA.findall(raw))
    if kana:
        return kana >= 4 and kana >= 0.15 * len(raw)
    n = len(words)
    if n < CLAUSE_WORDS:
        return False
    found = [w for w in words if free[w]]
    f = len(found)
    if f and n > CLAUSE_WORDS and (ended or ENDED.search(raw)):
        return True
    bound = [w for w in words if function[w]]
    if len(bound) >= BOUND_SHARE * n and len(set(bound)) >= BOUND_KINDS:
        return True
    if f < CLAUSE_FUNCTION:
        return False
    return f >= CLAUSE_SHARE * n or (f >= LOOSE_SHARE * n and len(set(found)) > CLAUSE_FUNCTION)


def blocks_of(text: str, known: frozenset = FUNCTION) -> list[tuple[int, int, bool, str]]:
    """(letters, letters covered by repeats or in links, is writing, text) of the stretches of a page.

    Segments with a clause stand alone; neighbouring ones without make one stretch, as the items of a list do.
    """
    text = repaired(html.unescape(text), known).replace("\xa0", " ")
    ids: dict[str, int] = {}
    spelled = _Spelled(ids)
    seq: list[int] = []
    segments: list[tuple[int, int, bool, str, int]] = []  # first, end, is a link or tag, bare text, its length
    for line in SEGMENT.findall(text):
        if NOTICE.search(line):
            continue
        for raw in SENTENCE.split(line):
            # no link without a point that is followed by something, or a scheme
            bare, marks = LINK.subn(" ", raw) if "." in raw[:-1] or ("://" in raw and "." in raw) else (raw, 0)
            first = len(seq)
            seq += [spelled[w] for w in WORD.findall(bare)]
            lost = raw.count("\ufffd")
            marked = marks > 0 or (not ARROWS.isdisjoint(raw) and bool(ARROW.search(raw))) or ("#" in raw and bool(TAGS.search(raw)))
            marked = marked and 2 * lost <= len(raw)  # a link in text that is lost says nothing of that text
            if len(seq) > first or marked:
                segments.append((first, len(seq), marked, bare, len(raw) - lost))
    if not segments:
        return []
    by_number = list(ids)
    free = [False] * len(ids)
    function = [False] * len(ids)
    number = ids.get("#", -1)
    at = np.array(seq, np.int64)
    after = np.append(at[1:], -1)
    counts = np.bincount(at, minlength=len(ids)).tolist()
    for word, k in ids.items():
        if word in known:
            function[k] = free[k] = True
            if counts[k] >= BOUND_TIMES:
                behind = after[at == k]
                free[k] = bool((behind != behind[0]).any()) or int(behind[0]) == number
    # Words stand between single blanks, so that a short word repeated is a repeat of some length as well.
    length_of = np.array([len(w) for w in by_number], np.int64)
    weight_of = np.array([0 if w == "#" else len(w) - w.count("\ufffd") for w in by_number], np.int64)
    sizes = length_of[at] if seq else at
    begin = np.cumsum(sizes + 1) - sizes
    total = np.append(0, np.cumsum(repeated(f" {' '.join([by_number[k] for k in seq])} ", DEPTH, TIMES)))
    weights = weight_of[at] if seq else at
    caught_at = np.where(total[begin + sizes] - total[begin] >= sizes, weights, 0)
    weighed, met = ([0, *np.cumsum(x).tolist()] for x in (weights, caught_at))  # up to each word
    out: list[tuple[int, int, bool, str]] = []
    size = caught = 0
    held: list[str] = []
    for first, end, marked, bare, length in segments:
        n = weighed[end] - weighed[first]
        if has_clause(bare, seq[first:end], free, function, marked):
            if held:
                out.append((size, caught, False, " / ".join(held)))
                size, caught, held = 0, 0, []
            out.append((n, met[end] - met[first], True, bare))
            continue
        held.append(bare)
        if marked:
            n = max(n, length)
            caught += n
        else:
            caught += met[end] - met[first]
        size += n
    if held:
        out.append((size, caught, False, " / ".join(held)))
    return out


def measure(text: str | None, raw: bytes | None = None, known: frozenset = FUNCTION) -> tuple[int, int, int]:
    """(letters of stuffing, letters of other content, letters caught) of a page's own content.

    An unreadable text is read again from the body (raw); where that is no better, the letters left are judged.
    """
    stuffed = other = repeats = 0
    need = COVERED
    if text and text.count("\ufffd") > UNREADABLE * len(text):
        again = body_text(raw) if raw else None
        if again is None:
            need = COVERED_UNREADABLE
        else:
            text = again
    for size, caught, writing, _ in blocks_of(text, known) if text else ():
        repeats += caught
        if not writing and caught >= need * size:
            stuffed += size
        else:
            other += size
    return stuffed, other, repeats


def is_stuffed(stuffed: int, other: int) -> bool:
    return stuffed >= LEAST and stuffed > MOST * (stuffed + other)


#: Clause words are learnt for languages with at least so many pages.
LEARN_PAGES = 100
#: A clause word occurs in the sentences of so many of a language's pages, in so many times more pages there than outside of
#: sentences, and with so many different words behind it; a language has at most so many.
IN_PAGES, MORE_THAN_OUTSIDE, FOLLOWERS, MOST_WORDS = 0.05, 8, 20, 300
#: Pages whose pairs of neighbouring words are held before they are counted.
PAIRS_PAGES = 500


def learn_clause_words(docs: DataFrame) -> frozenset:
    """Words that belong to sentences, by language, learnt from pages that label themselves: segments of some words that end
    like a sentence against all others. docs: text, lang. All pages are counted; at most MOST_WORDS a language come back.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages: dict = {}  # by language, as the others
            inside: dict = {}
            outside: dict = {}
            after: dict = {}
            pairs: dict = {}  # neighbours, before they are counted

            def counted() -> None:
                for lang, some_pairs in pairs.items():
                    follow = after.setdefault(lang, {})
                    for a, b in some_pairs:
                        some = follow.get(a)
                        if some is None:
                            follow[a] = {b}
                        elif len(some) < FOLLOWERS:
                            some.add(b)
                pairs.clear()

            for k, (lang, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if k % PAIRS_PAGES == 0:
                    counted()
                pages[lang] = pages.get(lang, 0) + 1
                within, beside = set(), set()
                beginning = pairs.setdefault(lang, set())
                for line in SEGMENT.findall(text.lower()):
                    for raw in SENTENCE.split(line):
                        words = [w for w in WORD.findall(raw) if w.isalpha()]
                        if len(words) >= CLAUSE_WORDS and ENDED.search(raw):
                            within.update(words)
                            beginning.update(zip(words, words[1:]))
                        else:
                            beside.update(words)
                inside.setdefault(lang, Counter()).update(within)
                outside.setdefault(lang, Counter()).update(beside)
            if not pages:
                continue
            counted()
            # A word that stands in no sentence here still counts outside of them.
            rows = [(lang, w, inside[lang][w], outside[lang][w], list(after.get(lang, {}).get(w, ()))) for lang in pages for w in inside[lang].keys() | outside[lang].keys()]
            rows += [(lang, None, n, 0, []) for lang, n in pages.items()]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(zip(*rows), kinds)], names=["lang", "word", "inside", "outside", "after"])

    counted = docs.where("text is not null").select("lang", "text").mapInArrow(count, "lang string, word string, inside long, outside long, after array<string>")
    sums = counted.groupBy("lang", "word").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"), F.size(F.array_distinct(F.flatten(F.collect_list("after")))).alias("after"))
    sums = Scratch(docs.sparkSession, "words").keep(sums)
    pages = sums.where(f"word is null and inside >= {LEARN_PAGES}").select(F.col("lang").alias("of"), F.col("inside").alias("pages"))
    words = sums.where("word is not null").join(F.broadcast(pages.limit(10_000)), F.col("lang").eqNullSafe(F.col("of")))
    words = words.where((F.col("inside") >= IN_PAGES * F.col("pages")) & (F.col("inside") >= MORE_THAN_OUTSIDE * F.col("outside")) & (F.col("after") >= FOLLOWERS))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("inside"), "word"))
    return frozenset(r["word"] for r in words.withColumn("k", rank).where(F.col("k") <= MOST_WORDS).select("word").collect())


def find_stuffed(docs: DataFrame, learn: bool = True) -> DataFrame:
    """Measures of each page: doc_id, stuffed, other, repeats, is_stuffed.

    docs: doc_id, text and, where there is one, raw (the body, read where the text is unreadable). Null and empty texts have nothing and are no cases; whole texts are read;
    rows of one doc_id are judged each by itself; further columns are ignored. learn: whether clause words are learnt from
    docs, which then has lang, besides those of FUNCTION_WORDS.
    """
    known = FUNCTION | (learn_clause_words(docs) if learn and "lang" in docs.columns else frozenset())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [measure(t, r, known) for t, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            s, o, r = (pa.array([g[k] for g in got], pa.int64()) for k in range(3))
            case = pa.array([is_stuffed(g[0], g[1]) for g in got], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), s, o, r, case], names=["doc_id", "stuffed", "other", "repeats", "is_stuffed"])

    raw = F.when(F.col("text").contains("\ufffd"), F.col("raw")) if "raw" in docs.columns else F.lit(None).cast("binary")
    return docs.select("doc_id", "text", raw.alias("raw")).mapInArrow(run, "doc_id long, stuffed long, other long, repeats long, is_stuffed boolean")
