import random

from lanternway.llm import stuffing as S


def brute_repeated(text, depth, times):
    out = [False] * len(text)
    for n in range(depth, len(text) + 1):
        for i in range(len(text) - n + 1):
            part = text[i : i + n]
            if "#" not in part and sum(text.startswith(part, k) for k in range(len(text))) >= times:
                out[i : i + n] = [True] * n
    return out


def test_coverage_against_brute_force():
    """Every character in any repeated substring of the depth and more, of whatever length."""
    rng = random.Random(2)
    for n in (0, 1, 3, 40, 60):
        for depth in (1, 2, 3, 6):
            for times in (2, 3):
                text = "".join(rng.choice("aab#") for _ in range(n))
                assert S.repeated(text, depth, times).tolist() == brute_repeated(text, depth, times)


def test_clause_words_are_learnt(spark):
    """An invented language: its small words join sentences, its nouns stand in lists as well."""
    rng = random.Random(7)
    nouns = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(60)]
    small = ["zu", "qer", "xan", "voi"]

    def sentence():
        return " ".join(w for _ in range(4) for w in (rng.choice(small), rng.choice(nouns))) + "."

    pages = [(k, sentence() + " " + sentence() + "\n" + "\n".join(rng.sample(nouns, 12)), "xx") for k in range(150)] + [(900, None, "xx"), (901, "", None)]
    docs = spark.createDataFrame(pages, "doc_id long, text string, lang string")
    learnt = S.learn_clause_words(docs)
    assert learnt == frozenset(small)
    prose = "\n".join(" ".join(w for _ in range(4) for w in (rng.choice(small), n)) for n in nouns[:8] for _ in range(3))
    assert not S.is_stuffed(*S.measure(prose, None, S.FUNCTION | learnt)[:2]) and S.is_stuffed(*S.measure("\n".join(nouns[:8] * 6), None, S.FUNCTION | learnt)[:2])
    assert S.learn_clause_words(docs.limit(0)) == frozenset()


PLACES = ["Tamford", "Quilby", "Norstead", "Velmora", "Istane", "Pellusk", "Ondora", "Galeth", "Wenwick", "Zelford", "Jorby", "Kemill", "Sarusk", "Torane", "Marelle"]
PROSE = "The committee asked for a second look at the stairway, although the organist had warned us. When it rained the ferry crew kept the pump dry, and nobody at the office knew why. If you walk to the mill, keep the yard on your left until the crossing. She wrote that the towpath felt narrow after dark."
CASES = {
    "prose": (PROSE, False),
    "no punctuation": (PROSE.replace(".", "").replace(",", "").lower(), False),
    "keywords": (", ".join(["rain jacket", "power bank", "Rain Jacket cheap", "yoga mat"] * 20), True),
    "leet": (" | ".join(["r4in jack3t", "p0wer b4nk", "y0ga mat ch3ap"] * 20), True),
    "places": ("\n".join(f"buy city tour {p}" for p in PLACES * 2), True),
    "links": ("\n".join(f"{p} - https://shop-{p.lower()}.example/a.html" for p in PLACES), True),
    "tags": ("\n".join(f"{c} {m} {t} size 4{k} SKU{k}771" for k, (c, m, t) in enumerate([("red", "wool", "hat"), ("blue", "cork", "mat"), ("red", "cork", "bag"), ("teal", "wool", "mat"), ("blue", "wool", "bag")] * 6)), True),
    "timetable": ("\n".join(f"{6 + k}:{k + 10}  {p}  D{k}" for k, p in enumerate(PLACES)), False),
    "register": ("\n".join(f"{p}\t{k * 7}\t{k * 311} m\t19{k + 10}" for k, p in enumerate(PLACES)), False),
    "song": ("\n".join(["We walk along the river when the evening bell is ringing", "And all of us are singing as the lamps are lit below"] * 8), False),
    "error": ("404 - nothing here\n" * 4, False),
    "notice only": ("We use cookies to make this site work. Accept all | Settings", False),
    "mixed, mostly prose": (PROSE + "\n" + PROSE.replace("The", "A") + "\nrain jacket, power bank, rain jacket, power bank, rain jacket", False),
    "japanese keywords": (", ".join(["激安 靴", "リュック 通販", "激安 靴 価格"] * 20), True),
    "japanese prose": ("大野原の裏にある渡し場は古いので注意が必要です。新しい公園はみんなに喜ばれた。" * 3, False),
    "russian read as another charset": ("Мы долго искали тоннель и вышли к реке, потому что мост был закрыт. Никто из нас не помнил, как это было.".encode("koi8-r").decode("cp1251"), False),
    "empty": ("", False),
    "null": (None, False),
    "one word": ("word", False),
    "very long": ("sale " * 200_000, True),
}


def test_pages(spark):
    names = list(CASES)
    df = spark.createDataFrame([(i, CASES[n][0], "x") for i, n in enumerate(names)], "doc_id long, text string, stuffed string")
    got = {names[r.doc_id]: r.is_stuffed for r in S.find_stuffed(df).collect()}
    assert got == {n: want for n, (_, want) in CASES.items()}


def test_no_pages(spark):
    assert S.find_stuffed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
