import hashlib
import hmac
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from prefrank import fixed_values as fixed
from prefrank.functions import privacy

MAIN = {
    "Meu CPF é 123.456.789-09.": "Meu CPF é [CPF_REDACTED].",
    "Cartão: 4111 1111 1111 1111 ok": "Cartão: [CARD_REDACTED]ok",
    "3714 496353 98431": "[CARD_REDACTED]",
    "5500000000000004": "[CARD_REDACTED]",
    "11987654321": "[CPF_REDACTED]",
    "11222333000144": "[CNPJ_REDACTED]",
    "11.222.333/0001-44": "[CNPJ_REDACTED]",
    "+55 (11) 98765-4321": "+55 [PHONE_REDACTED]",
    "(21) 98765-4321": "[PHONE_REDACTED]",
    "maria.silva@empresa.com": "[EMAIL_REDACTED]",
    "x@y.c|m fim": "[EMAIL_REDACTED] fim",
    "é12345678909": "é12345678909",
    "joão@loja.com.br": "joão@loja.com.br",
    "12345678901234567890123": "12345678901234567890123",
    "Como funciona o parcelamento?": "Como funciona o parcelamento?",
    "": "",
}
PORTUGUESE = {
    "4111111111111111": "[CPF_REMOVIDO]11111",
    "x 4111-1111-1111-1111 y": "x [CARTAO_REMOVIDO]y",
    "11.222.333/0001-44": "11.222.333/0001-44",
    "tel 11 3333-4444": "tel [TELEFONE_REMOVIDO]",
    "joão@loja.com.br": "joã[EMAIL_REMOVIDO]",
    "CPF 111.222.333-44 e CPF 99988877766": "CPF [CPF_REMOVIDO] e CPF [CPF_REMOVIDO]",
}


def python_redact(text, rules):
    for _, pattern, placeholder in rules:
        text = re.sub(pattern, placeholder, text)
    return text


@pytest.mark.parametrize("expected,dialect", [(MAIN, privacy.MAIN), (PORTUGUESE, privacy.PORTUGUESE)])
def test_exact_redaction(column, expected, dialect):
    assert column(privacy.redact("t", dialect), list(expected)) == list(expected.values())


def test_detection_matches_redaction_and_clears(column):
    texts = list(MAIN)
    found = column(privacy.has_pii("t"), texts)
    assert found == [MAIN[t] != t for t in texts]
    assert not any(column(privacy.has_pii(privacy.redact("t")), texts))
    assert column(privacy.has_pii("t"), [None]) == [False]


# Digits, separators and letters in many orders, non-ASCII digits and spaces included.
PIECES = st.lists(st.sampled_from(
    ["1", "2", "9", "11", "987", "0001", "12345678", "٣", ".", "-", " ", "/", "(", ")", "@", "a", "é", " ",
     "x.com", "b@c.de", "|", "\n", "_"]), max_size=24).map("".join)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(PIECES, min_size=20, max_size=60))
def test_redaction_equals_python_re(column, texts):
    for dialect in (privacy.MAIN, privacy.PORTUGUESE):
        wanted = [python_redact(t, dialect.rules) for t in texts]
        assert column(privacy.redact("t", dialect), texts) == wanted
    any_rule = [any(re.search(p, t) for _, p, _ in fixed.PII_MAIN) for t in texts]
    assert column(privacy.has_pii("t"), texts) == any_rule


def test_types(column):
    texts = ["11987654321", "a@b.co 123.456.789-09", "nada"]
    assert column(privacy.pii_types("t"), texts) == [["cpf", "phone"], ["cpf", "email"], []]
    assert column(privacy.redacted_types("t"), texts) == [["cpf"], ["cpf", "email"], []]


def test_pseudonym_is_hmac(column):
    values = ["user-1", "", "joão", "x" * 200]
    for salt in ("s", "k" * 100):
        wanted = [hmac.new(salt.encode(), v.encode(), hashlib.sha256).hexdigest() for v in values]
        assert column(privacy.pseudonymize("t", salt), values) == wanted


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab \t\n\r\x00\x0b\x1c\x1f\x7f\u0085  ​　é")),
                        max_size=12), min_size=10, max_size=40))
def test_clean_up_equals_python(column, texts):
    def clean(text):
        return re.sub(r"\s+", " ", re.sub(fixed.CONTROL_CHARACTERS, "", text)).strip()

    assert column(privacy.normalize_text("t"), texts) == [clean(t) for t in texts]
    assert column(privacy.strip("t"), texts) == [t.strip() for t in texts]
    assert column(privacy.rstrip("t"), texts) == [t.rstrip() for t in texts]
    assert column(privacy.is_blank("t"), texts) == [not t.strip() for t in texts]
    blank_after = column(privacy.is_blank(privacy.redact("t")), texts)
    assert blank_after == [not t.strip() for t in texts]
