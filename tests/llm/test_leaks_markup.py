"""Words of texts whose mark-up is written in odd characters."""

import time

from duelframe.llm import leaks


def test_markup_in_any_characters():
    plain = ["one", "two", "cafe", "dont"]
    for text in (
        "one <b>two</b> café don't", "one <b>two</\u200cb> café don’t", "ｏｎｅ ＜ｂ＞ｔｗｏ＜／ｂ＞ ｃａｆé don't", "one&nb\u200bsp;two cafe\u0301 don't", "one<br/\u00ad>two caf&eacute; don&#39;t",
        "one <a href='x' title=\"" + "y " * 900 + "\">two</a><!-- <b>hidden</b> --> caf\\u00e9 don't", "**one** _two_ | CAFÉ | DON'T", "one&#8203; tw&#8203;o café don't",
    ):
        assert leaks.words_of([text]) == [plain], text
    assert leaks.words_of(["1 < 2 and 3 > 2", None, ""]) == [["1", "2", "and", "3", "2"], [], []]


def test_broken_markup_takes_no_long_time():
    began = time.perf_counter()
    leaks.words_of(["<a " + "b=c " * 200_000, "<" * 200_000, "<!--" * 50_000, "<a " + "x " * 200_000 + "<"])
    assert time.perf_counter() - began < 20
