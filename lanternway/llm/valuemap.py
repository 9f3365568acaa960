"""Mapping freely typed values to a canonical list by a prefix-filter set-similarity join.

Distinct values only are worked on. Each is cut into windows of neighbouring words, and each window into
a set of tokens (its letters, counted, and its letter pairs). Tokens are ordered by rarity among the windows and
the list's forms; both meet in an equi-join on the rare prefixes of their token sets, the length and
positional filters drop most pairs, the Jaccard similarity of the rest is computed exactly, pairs further apart than
slips of the hand explain are dropped, and the most similar is kept. A value means an entry if its windows agree on it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternway.runtime import Scratch, salted_join

#: Letters of other alphabets that look like Latin ones; fixed values.
LOOKALIKES = str.maketrans("асеорхуіјѕкмтнвԁɡοαρντυικ", "aceopxyijskmthbdgoapvtuik")
DASHES = "−–—‐‑‒﹣－"
#: Words that turn what stands beside them into something else, and words that say nothing about it. Fixed lists.
DOUBT = frozenset("or not no later formerly former was were then and oder ou idea sure unsure unknown either neither nor vs versus unless except than instead until".split())
PLAIN_BESIDE = frozenset("only mostly probably likely maybe perhaps about a an the is sign checked ok confirmed see value tag way type kind class of".split())


def plain(text: str) -> str:
    """Lower case without marks, invisible characters and look-alike letters."""
    t = unicodedata.normalize("NFKC", text).casefold()
    t = "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch) and unicodedata.category(ch) != "Cf")
    for d in DASHES:
        t = t.replace(d, "-")
    if any("a" <= ch <= "z" for ch in t):
        t = t.translate(LOOKALIKES)
    return t


def compact(text: str) -> str:
    return "".join(ch for ch in plain(text) if ch.isalnum())


def token_set(word: str) -> list[str]:
    """Letters, counted, and letter pairs with the ends marked."""
    seen: dict[str, int] = {}
    out = []
    for ch in word:
        seen[ch] = seen.get(ch, 0) + 1
        out.append(f"{ch}{seen[ch]}")
    padded = f"^{word}$"
    pairs: dict[str, int] = {}
    for i in range(len(padded) - 1):
        p = padded[i : i + 2]
        pairs[p] = pairs.get(p, 0) + 1
        out.append(p if pairs[p] == 1 else f"{p}{pairs[p]}")
    return out


def distance(a: str, b: str, most: int = 4) -> int:
    """Edit distance with swaps of neighbours (optimal string alignment); most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def slips(form: str) -> int:
    """How many slips a form of that length may have suffered and still be told from others."""
    n = len(form)
    return 0 if n < 3 else 1 if n < 6 else 2 if n < 12 else 3


#: Least Jaccard similarity of token sets that slips can leave: n letters make 2n + 1 tokens, and a slip costs at most three on either side. Least at six letters, 7 of 19.
SIMILAR = min((2 * n + 1 - 3 * k) / (2 * n + 1 + 3 * k) for n in range(3, 13) for k in [slips("x" * n)]) - 1e-9


NUMBER = re.compile(r"^\s*(-?)\s*(\d+)(?:[.,]0+)?(?![\d.,]*\d)")


def cut(key: str, value: str) -> tuple[list[str], list[str], list[int]]:
    """(words, what stood before each word, bracket depth of each) of a value without its leading key name."""
    t = plain(value)
    t = re.sub(rf"^\s*(?:{re.escape(plain(key))}|value|tag|key|k|v)\s*[:=]\s*", "", t)
    words, gaps, depths = [], [], []
    at = depth = 0
    for m in re.finditer(r"(?<![^\W_])-?\s?\d+(?:[.,]\d+)?|[^\W\d_]+|\d+", t):
        gap = t[at : m.start()]
        depth = max(0, depth + sum(ch in "([{" for ch in gap) - sum(ch in ")]}" for ch in gap))
        w = m.group().replace(" ", "")
        if re.fullmatch(r"-?\d+[.,]0+", w):
            w = re.split(r"[.,]", w)[0]
        words.append(w)
        gaps.append(gap)
        depths.append(depth)
        at = m.end()
    gaps.append(t[at:])
    return words, gaps, depths


def windows(key: str, value: str, longest: int) -> list[tuple[int, int, str]]:
    """(first word, end, compact text) of all runs of words no longer than ``longest`` letters."""
    words, _, _ = cut(key, value)
    out = []
    for i in range(len(words)):
        text = ""
        for j in range(i, len(words)):
            text += words[j]
            if len(text) > longest:
                break
            out.append((i, j + 1, text))
    return out


def judge(key: str, value: str, found: list[tuple[int, int, str, str, float]]) -> str:
    """The canonical entry that a value means, or "unmatched".

    found: (first word, end, canonical, form, similarity) of windows. Windows that cover more come first; those
    outside brackets rule out those inside; what is left of the value must not speak of something else.
    """
    words, gaps, depths = cut(key, value)
    taken: list[tuple[int, int, set[str], float]] = []
    # Of readings that overlap the one is meant with most tokens in common, less half of those that only one side has; equal ones leave it open.
    def worth(f: tuple) -> float:
        tokens = 2 * (len("".join(words[f[0] : f[1]])) + len(f[3])) + 2
        return round(tokens * (2 * f[4] / (1 + f[4]) - 0.5), 6)

    ranked = sorted(found, key=lambda f: (-worth(f), f[0], f[2]))
    for f in ranked:
        over = [t for t in taken if f[0] < t[1] and t[0] < f[1]]
        if not over:
            taken.append((f[0], f[1], {f[2]}, worth(f)))
        for t in over:
            if t[:2] == f[:2] and worth(f) >= t[3]:
                t[2].add(f[2])
    outside = [t for t in taken if min(depths[t[0] : t[1]]) == 0]
    taken = outside or taken
    names = set().union(*(t[2] for t in taken)) if taken else set()
    if len(names) != 1:
        return "unmatched"
    used = {k for a, b, *_ in taken for k in range(a, b)}
    rest = [k for k in range(len(words)) if k not in used]
    (name,) = names
    short = max(len("".join(words[a:b])) for a, b, *_ in taken) <= 3
    for k in rest:
        if depths[k]:
            continue
        # Behind a comma, a dash or the like stands a remark; only its words of doubt count.
        first = min(used)
        between = "".join(gaps[min(k, first) + 1 : max(k, first) + 1])
        remark = any(ch in between for ch in ",;-:/|")
        if words[k] in DOUBT:
            return "unmatched"
        if "?" in "".join(gaps) and k > first and "/" in between:
            return "unmatched"
        if short and not remark and words[k] not in PLAIN_BESIDE and not words[k].isdigit():
            return "unmatched"
    return name


def entry_forms(reference: DataFrame) -> DataFrame:
    """(tag_key, canonical, form) of each entry: its name, label-free aliases, and their words turned round.

    A form that several entries of a key share is none of theirs.
    """
    raw = reference.where("tag_key is not null and canonical is not null").select(
        "tag_key", "canonical", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.expr("cast(array() as array<string>)")))).alias("name")
    ).where("name is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, canonical, name in pdf.itertuples(index=False):
                words, _, _ = cut("", name)
                forms = {"".join(words)}
                if len(words) > 1:
                    forms.add("".join(words[1:] + words[:1]))
                    forms.add("".join(words[-1:] + words[:-1]))
                rows += [(key, canonical, f, words[0] if words else "") for f in forms if f]
            yield pd.DataFrame(rows, columns=["tag_key", "canonical", "form", "head"])

    forms = raw.mapInPandas(run, "tag_key string, canonical string, form string, head string")
    return forms.groupBy("tag_key", "form").agg(F.min("canonical").alias("canonical"), F.max("canonical").alias("other")).where("canonical = other").drop("other")


def _token_udf():
    @F.pandas_udf("array<string>")
    def tokens(s: pd.Series) -> pd.Series:
        return s.map(token_set)

    return tokens


def jaccard(a: str, b: str) -> float:
    """Jaccard similarity of the token sets of two words."""
    x, y = _tokens(a), _tokens(b)
    common = len(x & y)
    return common / (len(x) + len(y) - common)


@lru_cache(maxsize=100_000)
def _tokens(word: str) -> frozenset[str]:
    return frozenset(token_set(word))


#: Forms up to which the list's prefixes go to every task: some 25 short rows a form.
BROADCAST_FORMS = 20_000


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """Pairs of a text of ``left`` and one of ``right`` of the same key whose token sets have a Jaccard
    similarity of at least ``threshold``: (tag_key, text, form, similarity).

    left: distinct (tag_key, text). right: distinct (tag_key, form), the smaller side. Exact: the prefix,
    length and positional filters only drop pairs that cannot reach the threshold. Rarity is counted over both sides.
    Only places in prefixes travel, no sets; frequent tokens are spread over salts.
    """
    tokens = _token_udf()
    key = F.concat_ws("\x00", "tag_key", "token").alias("token")
    both = left.select("tag_key", "text", F.lit(True).alias("typed")).unionByName(right.select("tag_key", F.col("form").alias("text"), F.lit(False).alias("typed")))
    each = both.select("tag_key", "text", "typed", F.explode(tokens("text")).alias("token")).select("tag_key", "text", "typed", key)
    each = Scratch(left.sparkSession, "tokens").keep(each)
    rarity = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("typed")).alias("listed"))
    ranked = salted_join(each, rarity, "token", F.col("text")).groupBy("tag_key", "text", "typed").agg(F.array_sort(F.collect_list(F.struct("n", "token", "listed"))).alias("o"))
    size = F.size("o")
    prefix = F.slice("o", F.lit(1), size - F.ceil(size * threshold).cast("int") + 1)

    def prefixes(typed: bool, name: str, tag: str) -> DataFrame:
        """One row a prefix token, with its place and the size of the set."""
        rows = ranked.where(F.col("typed") == typed).select("tag_key", F.col("text").alias(name), size.alias(f"size_{tag}"), F.posexplode(prefix).alias(f"at_{tag}", "t"))
        return rows.where("t.listed > 0").select(F.col("t.token").alias("token"), name, f"size_{tag}", f"at_{tag}", *(["tag_key"] if typed else []))

    met = prefixes(True, "text", "a")
    listed = prefixes(False, "form", "b")
    if right.count() <= BROADCAST_FORMS:
        met = met.join(F.broadcast(listed), "token")
    else:
        met = salted_join(met, listed, "token", F.col("text"))
    sizes = (F.col("size_a") >= threshold * F.col("size_b")) & (F.col("size_b") >= threshold * F.col("size_a"))
    overlap = threshold / (1 + threshold) * (F.col("size_a") + F.col("size_b"))
    positional = 1 + F.least(F.col("size_a") - F.col("at_a") - 1, F.col("size_b") - F.col("at_b") - 1) >= overlap - 1e-9
    # The bound holds at the first common token; a pair is kept if it holds at any, so none is lost.
    candidates = met.where(sizes & positional).select("tag_key", "text", "form").distinct()

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y) for x, y in zip(a, b)], dtype=float)

    return candidates.withColumn("similarity", similarity("text", "form")).where(F.col("similarity") >= threshold - 1e-12)


def map_values(values: DataFrame, reference: DataFrame) -> DataFrame:
    """The entry each distinct value means: tag_key, value, canonical ("unmatched" if none or open which).

    values: tag_key, value; nulls are skipped, repeated ones count once, blank ones are unmatched.
    reference: tag_key, canonical, aliases. A value of a key without entries is unmatched; a value
    of any length is read whole.
    """
    spark = values.sparkSession
    scratch = Scratch(spark, "valuemap")
    forms = scratch.keep(entry_forms(reference))
    longest = forms.agg(F.max(F.length("form"))).first()[0] or 0
    distinct = scratch.keep(values.where("tag_key is not null and value is not null").select("tag_key", "value").distinct())

    def cut_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, v, i, j, t) for k, v in zip(pdf["tag_key"], pdf["value"]) for i, j, t in windows(k, v, longest + 3)]
            yield pd.DataFrame(rows, columns=["tag_key", "value", "i", "j", "text"])

    cuts = scratch.keep(distinct.mapInPandas(cut_all, "tag_key string, value string, i int, j int, text string"))
    texts = cuts.select("tag_key", "text").distinct()
    pairs = similar_pairs(texts, forms.select("tag_key", "form"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = lru_cache(maxsize=200_000)(distance)
        for pdf in batches:
            n = [near(t, f, 3) for t, f in zip(pdf["text"], pdf["form"])]
            ok = pd.Series([d <= slips(f) and (d == 0 or not any(ch.isdigit() for ch in f)) for d, f in zip(n, pdf["form"])], dtype=bool)
            yield pdf.assign(slips=n)[ok.to_numpy()]

    # Abbreviations ("prim. link") pass by their prefixes instead of their distance.
    checked = pairs.mapInPandas(verify, "tag_key string, text string, form string, similarity double, slips int")
    # Of the forms within reach of a text the most similar one is kept, or several entries' forms of equal similarity.
    best = F.max("similarity").over(W.partitionBy("tag_key", "text"))
    named = checked.withColumn("best", best).where("similarity >= best").join(forms, ["tag_key", "form"])
    hits = cuts.join(named, ["tag_key", "text"]).groupBy("tag_key", "value").agg(F.collect_list(F.struct("i", "j", "canonical", "form", "similarity")).alias("found"))
    short = scratch.keep(abbreviations(distinct, reference))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [judge(k, v, [(h["i"], h["j"], h["canonical"], h["form"], h["similarity"]) for h in found]) for k, v, found in zip(pdf["tag_key"], pdf["value"], pdf["found"])]
            yield pd.DataFrame({"tag_key": pdf["tag_key"], "value": pdf["value"], "canonical": got})

    decided = hits.mapInPandas(decide, "tag_key string, value string, canonical string")
    return (
        distinct.join(decided, ["tag_key", "value"], "left")
        .join(short.withColumnRenamed("canonical", "abbreviated"), ["tag_key", "value"], "left")
        .select("tag_key", "value", F.coalesce(F.when(F.col("canonical") != "unmatched", F.col("canonical")), "abbreviated", F.lit("unmatched")).alias("canonical"))
    )


def abbreviations(distinct: DataFrame, reference: DataFrame) -> DataFrame:
    """Values with a word cut short by a full stop ("prim. link"): the entry whose words they begin, if only one."""
    dotted = distinct.where(F.col("value").rlike(r"\p{L}{3,}\."))
    names = reference.where("tag_key is not null and canonical is not null").select(
        "tag_key", "canonical", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.expr("cast(array() as array<string>)")))).alias("name")
    )
    # The first three letters are the rare prefix both sides share.
    head = lambda c: F.substring(F.regexp_replace(F.lower(c), r"[^\p{L}]", ""), 1, 3)
    met = dotted.withColumn("h", head(F.col("value"))).join(names.withColumn("h", head(F.col("name"))), ["tag_key", "h"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for key, value, name in zip(pdf["tag_key"], pdf["value"], pdf["name"]):
                a, gaps, _ = cut(key, value)
                b, _, _ = cut("", name)
                keep.append(len(a) == len(b) and all(len(x) >= 3 and (y.startswith(x) if gaps[i + 1].startswith(".") else x == y) for i, (x, y) in enumerate(zip(a, b))))
            yield pdf[keep][["tag_key", "value", "canonical"]]

    fits = met.select("tag_key", "value", "canonical", "name").mapInPandas(run, "tag_key string, value string, canonical string")
    return fits.groupBy("tag_key", "value").agg(F.min("canonical").alias("canonical"), F.max("canonical").alias("other")).where("canonical = other").drop("other")


def is_case(value: Column) -> Column:
    """Present and not blank."""
    return value.isNotNull() & (F.regexp_replace(value, r"[\s\p{Z}\p{Cf}]+", "") != "")
