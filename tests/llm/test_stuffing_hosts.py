from lanternway.llm import stuffing as S

NAMES = "amber birch cedar delta ember fjord grove haven islet jetty knoll larch".split()
ENDINGS = ["de", "ru", "co.uk", "io", "fr", "museum"]


def test_hosts_of_any_ending_are_links():
    listed = "\n".join(f"{n}-{k}x.{ENDINGS[k % 6]}" for k, n in enumerate(NAMES))
    assert S.is_stuffed(*S.measure(listed)[:2])
    for text in ("the end.Then it rained", "it took 3.5 km, i.e. long", "at 10.30am", "word. next"):
        assert not S.LINK.search(text)
