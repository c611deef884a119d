"""Personal data next to other digits."""

import re

import pytest

from almanac.llm import privacy

F = privacy.Feistel(b"test")
VALUES = {
    "card": ["4111 1111 1111 1111", "4111-1111-1111-1111", "3782 822463 10005", "4111111111111111"],
    "date": ["2024-01-15", "2024-02-15", "15/01/2024"],
    "ssn": ["123-45-6789"],
    "phone": ["212-555-1234", "(212) 555-1234"],
    "iban": ["BE68 5390 0754 7034", "DE89370400440532013000"],
}
ALL = [(k, v) for k, of in VALUES.items() for v in of]


@pytest.mark.parametrize("text, kinds", [
    ("4111 1111 1111 1111 123", {"card": 1}), ("4111-1111-1111-1111-123", {"card": 1}), ("2024-01-15 2024-02-15", {"date": 2}), ("123-45-6789 2024-01-15", {"ssn": 1, "date": 1}),
    ("123 212-555-1234", {"phone": 1}), ("BE68 5390 0754 7034 1234", {"iban": 1}), ("2024-01-15T10:30", {"date": 1}), ("411111111111 1111 123", {"card": 1}), ("77 411111111111 1111", {"card": 1}),
    ("on 2024-01-02 4111 1111 1111 1111 paid", {"date": 1, "card": 1}), ("ref 12345 4111 1111 1111 1111", {"card": 1}), ("id 2024-01-02 555-123-4567", {"date": 1, "phone": 1}),
    ("card 4111111111111111-", {"card": 1}), ("card 4111111111111111-x", {}), ("password: letmeinplease", {"secret": 1}), ("password: required", {}), ("Password: Required.", {}), ("token: something", {}),
    ("password: required@example.com", {"email": 1}), ("password: someone@example.com", {"email": 1}), ("2024-01-15Tuesday", {}), ("1 2 3 4 5 6 7 8 9 10 11 12 13 14 15", {}),
])
def test_values_beside_other_digits_are_found(text, kinds):
    new, counts = privacy.pseudonymise(text, F)
    assert dict(counts) == kinds
    assert re.sub(r"\w", "x", new) == re.sub(r"\w", "x", text)


def test_every_pair_of_values_gets_the_pseudonyms_of_its_parts():
    for ka, a in ALL:
        for kb, b in ALL:
            new, counts = privacy.pseudonymise(f"{a} {b}", F)
            assert (new, counts.total()) == (f"{privacy.pseudonymise(a, F)[0]} {privacy.pseudonymise(b, F)[0]}", 2), (a, b)


def test_pairs_of_dates_are_never_one_card():
    for day in range(1, 29):
        assert privacy.pseudonymise(f"2024-01-{day:02d} 2024-02-15", F)[1] == {"date": 2}
