from lanternway.llm import stuffing as S

KEYWORDS = ", ".join(["купить ботинки", "дешево", "Тарица: купить ботинки", "онлайн"] * 20)
PROSE = "Мы долго искали тоннель и вышли к реке http://best-istwick77.test/info, потому что мост был закрыт. Никто из нас не помнил, как это было. " * 4
PAGE = '<html><head><title>х</title></head><body><nav><a href="/">Поиск</a></nav><p>{}</p><footer>2019</footer></body></html>'
TAG_LINES = "\n".join(f"[{k}307] www-istmora{k}.invalid cotton-scarf {k}" for k in range(12))
LOST = "�" * 9


def test_unreadable_pages(spark):
    rows, want = [], []
    for charset in ("cp1251", "koi8-r"):
        for body, case in ((KEYWORDS, True), (PROSE, False)):
            rows.append((len(rows), body.encode(charset).decode("utf-8", "replace"), PAGE.format(body).encode(charset)))
            want.append(case)
    rows.append((len(rows), f"{LOST} {LOST}\n" * 30 + TAG_LINES, None))  # readable lines count where there is no body
    rows.append((len(rows), f"{LOST} {LOST} http://a-b.test/i {LOST} {LOST}\n" * 30, None))  # a link in lost text says nothing
    df = spark.createDataFrame(rows, "doc_id long, text string, raw binary")
    assert all(t.count("�") > 0.3 * len(t) for _, t, _ in rows)
    got = {r.doc_id: r.is_stuffed for r in S.find_stuffed(df).collect()}
    assert [got[k] for k in range(len(rows))] == [*want, True, False]


def test_body_in_the_charset_that_fits():
    for charset, text in (("euc_jp", "激安 靴 リュック 通販 を買った"), ("cp932", "激安 靴 リュック 通販 を買った"), ("koi8-r", "дешево купить"), ("cp1252", "günstig prêt à porter"), ("utf-8", "जल्दी खरीदें")):
        assert S.body_text(f"<p>{text}</p>".encode(charset)).strip() == text
    assert S.body_text(f"<p>{LOST} {LOST}</p>".encode()) is None
