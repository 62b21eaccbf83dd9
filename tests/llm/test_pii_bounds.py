"""Where added spans end."""

import time

import pytest

from ledgerspark.llm import pii

ADDRESSES = {
    'https://u:pw@host.com/x">here</a>.': "https://u:pw@host.com/x",
    "(https://bob:x1@h.org),": "https://bob:x1@h.org",
    "see https://site.org/~ann/wiki_(x). More": "https://site.org/~ann/wiki_(x)",
    "[ftp://a:b@h.net:21/f]": "ftp://a:b@h.net:21/f",
    "http://site.org/users/ann?tab=1!": "http://site.org/users/ann?tab=1",
    "http://site.org/about": None,
    "http://site.org/@": None,
    "http://u:p@": None,
    "http://u:p@ho_st/": None,
    "https://[::1]/@me": "https://[::1]/@me",
}
ACCOUNTS = {
    "account 1234567 MAY 2024": "1234567",
    "Account no. 12 345 678, paid": "12 345 678",
    "account: AB-123456-X9 today": None,
    "acct #A123456-X9 today": "A123456-X9",
    "IBAN DE89 3704 0044 0532 0130 00 is his": "DE89 3704 0044 0532 0130 00",
    "iban: GB82WEST12345698765432.": "GB82WEST12345698765432",
    "IBAN DE89 3704 0044 0532 0130 01": None,
    "passport P1234567 for": "P1234567",
    "ssn 123-45-6789 and 5": "123-45-6789",
    "ssn 000-45-6789": None,
    "accounts 1234567": None,
    "discount account12345": None,
    "konto 123456abc": None,
    "account 12345": None,
}


@pytest.mark.parametrize("text", ADDRESSES)
def test_addresses(text):
    assert [text[a:b] for a, b in pii.scanner()(text)["address"]] == ([ADDRESSES[text]] if ADDRESSES[text] else [])


@pytest.mark.parametrize("text", ACCOUNTS)
def test_accounts(text):
    assert [text[a:b] for a, b in pii.scanner()(text)["account"]] == ([ACCOUNTS[text]] if ACCOUNTS[text] else [])


@pytest.mark.parametrize("text", ["http://" * 20000, "http://a:b@" + "x." * 50000, "http://" + "(" * 50000 + ")" * 60000, "account " + "1 " * 50000, "account 1" + "-A" * 50000, "iban AB12" + " 1" * 50000, "account " * 20000, "http://a:b@h" * 20000, "http://a:b@h_" * 20000, "http://" * 9 + "a:b@h).,"])
def test_time(text):
    start = time.process_time()
    pii.scanner()(text)
    assert time.process_time() - start < 2
