"""Personal data in forms, and harmless numbers, that no training code writes down.

Everything here is spelled out by hand; nothing is drawn from ``pii``.
"""

from __future__ import annotations

import random

import pytest
from permitlake.llm import pii
from permitlake.llm.common import table
from worlds import DATA

LOCALS = ("anna", "anna.smith", "smith42", "a_smith", "j.doe-7")
HOSTS = ("gmail.com", "post.example.org", "mail7.example.com", "uni-koeln.de", "x.co")
SENTENCES = ("please write to {} before noon", "her entry reads {} and nothing else", "le contact est {} selon la liste", "{} was printed on the last page", "siehe {} im Anhang dazu")


def dotted(host, dot):
    return host.replace(".", dot)


EMAIL_FORMS = {
    "angle": lambda n, h: f"{n} <at> {h}",
    "strokes": lambda n, h: f"{n}_at_{h}",
    "square tight": lambda n, h: f"{n}[at]{dotted(h, '[dot]')}",
    "round and spelled": lambda n, h: f"{n} (at) {dotted(h, ' dot ')}",
    "upper": lambda n, h: f"{n} (AT) {dotted(h, ' (DOT) ')}",
    "words": lambda n, h: f"{n} at {dotted(h, ' dot ')}",
    "curly": lambda n, h: f"{n}{{at}}{h}",
    "stars": lambda n, h: f"{n}*at*{dotted(h, '*dot*')}",
    "spaced sign": lambda n, h: f"{n} @ {h}",
}
PHONES = ("0044-20-7946-0958", "1-800-555-0199", "(030) 4567 8901", "020/79460958", "0049 151 23456789", "(212) 555-0187", "415.555.0132", "0033 (1) 45678901", "030-45678901")
CARDS = ("4111|1111|1111|1111", "4111_1111_1111_1111", "5500/0000/0000/0004", "4111.1111.1111.1111", "3782-822463-10005/".rstrip("/"), "4000 - 0000 - 0000 - 0002", "6011:1111:1111:1117")
IPS = ("10-20-30-40", "192,168,7,201", "172[.]16[.]254[.]1", "8 . 8 . 4 . 4", "10 dot 0 dot 12 dot 7", "203_0_113_9", "198(.)51(.)100(.)23")
HARMLESS = {
    "isbn": ("978-3-16-148410-0", "9780306406157", "0-306-40615-2", "979-10-90636-07-1"),
    "order": ("111-2345678", "4021-556677", "302-1234567-7654321", "PO-2021-00417", "#88213450"),
    "serial": ("SN 4500123988", "7781200345", "XK-4471-229", "88213-4450"),
    "date": ("2021-03-04 14:30", "24.12.1999", "12/31/2020", "2020-2021", "20210304", "14:05:33"),
    "version": ("v2.13.4", "10.4.2", "3.11.0-rc1", "300.400.20.10"),
    "place": ("48.8566, 2.3522", "-33.8688 151.2093", "51.5 N 0.12 W"),
    "other": ("1,234,567.89", "look at the dot", "state-of-the-art", "meet at 5 dot", "3 x 4", "12 34 56 78"),
}


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(table(spark, DATA.replace("0.001", "0.1"), "documents"))


def whole(field, plain, kind):
    """Of the sentences around it, the share in which just this span is found."""
    found = 0
    for s in SENTENCES:
        text, at = s.format(plain), s.index("{}")
        found += (at, at + len(plain), kind) in pii.find(text, field)[1]
    return found


def test_addresses(field):
    per = {name: sum(whole(field, form(n, h), "email") for n in LOCALS for h in HOSTS) for name, form in EMAIL_FORMS.items()}
    most = len(LOCALS) * len(HOSTS) * len(SENTENCES)
    assert min(per.values()) >= 0.8 * most and sum(per.values()) >= 0.9 * most * len(per), per


@pytest.mark.parametrize("kind, forms", [("phone", PHONES), ("card", CARDS), ("ip", IPS)])
def test_numbers(field, kind, forms):
    per = {f: whole(field, f, kind) for f in forms}
    assert sum(per.values()) >= 0.9 * len(forms) * len(SENTENCES), per


def test_harmless_numbers_are_left_alone(field):
    per = {f: sum(bool(pii.find(s.format(f), field)[1]) for s in SENTENCES) for forms in HARMLESS.values() for f in forms}
    assert sum(per.values()) <= 0.05 * len(per) * len(SENTENCES), {f: n for f, n in per.items() if n}


def test_prose_is_left_alone(field):
    r = random.Random(4)
    words = "the committee met at noon and looked at every dot on the map while he said (at last) that nothing <or so> was left _there_ 1 2 30 400".split()
    assert not any(pii.find(" ".join(r.choice(words) for _ in range(60)), field)[1] for _ in range(100))
