"""Values that once stayed in clear, planted in sentences, are gone; what is none stays."""

import datetime
import re

import pytest

from almanac.llm.privacy import DEMO_KEY, FIRST, Feistel, date, pseudonymise

F = Feistel(DEMO_KEY)


@pytest.mark.parametrize(("text", "value", "kind"), [
    ('set pwd="p@ssw0rd!x" now', "p@ssw0rd!x", "secret"), ("password = 'two words 12'", "two words 12", "secret"), ("pwd=p@ssw0rd!x and", "p@ssw0rd!x", "secret"), ("password: bob.smith@example.com", "bob.smith@example.com", "email"),
    ("call 555.234.4567x12 today", "555.234.4567", "phone"), ("card 4111 1111  1111 1111 is", "4111 1111  1111 1111", "card"),
    ("born 02-03-1990", "02-03-1990", "date"), ("born 1990/03/02.", "1990/03/02", "date"), ("born 03/25/1990,", "03/25/1990", "date"), ("born 25/03/1990", "25/03/1990", "date"),
])
def test_values_are_gone(text, value, kind):
    out, counts = pseudonymise(text, F)
    assert value not in out and counts[kind] == 1 and sum(counts.values()) == 1
    assert len(out) == len(text) and re.sub(r"\w", "w", out) == re.sub(r"\w", "w", text)
    assert pseudonymise(text, F)[0] == out


@pytest.mark.parametrize("text", ["password required!", 'password: "required"', "the token: see below", "a 99/99/2000 b", "version 1-2-2000", 'he said "secret: hush"', "13/13/2000"])
def test_other_texts_stay(text):
    assert pseudonymise(text, F)[0] == text


def test_dates_with_the_month_first_stay_apart():
    """Images of dates that can only have the month first do too, so none meets the image of another form."""
    days = [datetime.date.fromordinal(FIRST + 97 * i) for i in range(300)]
    first = {date(F, d.strftime("%m/%d/%Y")) for d in days if d.day > 12}
    assert len(first) == sum(d.day > 12 for d in days)
    assert all(int(x[3:5]) > 12 for x in first)
