"""Behaviour that is easy to get wrong, one case each."""

import pytest
from pyspark.sql import functions as F

from foliospark.functions import features, forms, invoice, mail, resume, results
from foliospark.functions import text as tx
from foliospark.functions.language import is_non_english, language_name
from foliospark.operators.splitting import fold_count, wants_search

NUMBERS = [
    ("Invoice No: INV-0042.", "INV-0042"),
    ("Invoice #: 2026-00123", "2026-00123"),
    ("INVOICE ID A/2026/00042", "A/2026/00042"),
    ("Invoice: X-9", "X-9"),
    ("Reference: REF-1", "REF-1"),
    ("References available", "erences"),
    ("a report 7", "rt"),
    ("Order No. 98765", "98765"),
    ("see BILL_0815A", "BILL_0815A"),
    ("see bill_0815A", None),
    ("Invoice No: 12", None),
    ("Invoice No: 12 PO-4711", "4711"),
    ("nothing here", None),
]


@pytest.mark.parametrize("text,expected", NUMBERS)
def test_invoice_number(value, text, expected):
    assert value(invoice.invoice_number, text) == expected


def test_strict_numbers_start_at_word_boundaries(value):
    assert value(lambda c: invoice.invoice_number(c, strict=True), "a report 7") is None
    assert value(lambda c: invoice.invoice_number(c, strict=True), "Ref: AB-1") == "AB-1"


def test_a_due_date_in_front_becomes_the_invoice_date(value):
    text = "Due Date: 01/02/2024\nInvoice Date: 01/01/2024"
    assert value(invoice.invoice_date, text) == "01/02/2024"


def test_date_on_the_next_line(value):
    assert value(invoice.due_date, "Net 30\n\n 3rd of March, 2024") == "3rd of March, 2024"


TOTALS = [
    ("Total: 550\n12 pcs", "55012"),
    ("Sub total 90\nTotal 100", "90"),
    ("Subtotal 90\nTotal 100", "100"),
    ("Total 100\nGrand Total 120.", "120"),
    ("Total payable: £ 1 250.00", "1250.00"),
    ("TOTAL EUR 1.250,00 x", "1.250,00"),
    ("Amount Due $€ 7", "7"),
    ("total", None),
]


@pytest.mark.parametrize("text,expected", TOTALS)
def test_total(value, text, expected):
    assert value(invoice.total_amount, text) == expected


def test_a_long_gap_after_a_label_stays_cheap(value):
    assert value(invoice.total_amount, "Total" + " " * 20000 + "x") is None


FLOATS = [
    ("1.250,00", 1250.0),
    ("1,234.56", 1234.56),
    ("1250,", 1250.0),
    ("1.250", 1.25),
    ("1.2.3", None),
    (",", None),
    ("", None),
    (None, None),
    ("12d", None),
    ("nan", None),
    (" 7 ", 7.0),
]


@pytest.mark.parametrize("text,expected", FLOATS)
def test_to_float(value, text, expected):
    assert value(tx.to_float, text) == expected


def test_party_labels_are_found_inside_words(value):
    assert value(invoice.issuer, "Supplier#000000007\nx") == "#000000007"


def test_label_without_a_name_falls_back_to_the_top(value):
    assert value(invoice.issuer, "Acme\nFrom: \nInvoice 1\n12345") == "Acme"
    assert value(invoice.recipient, "Acme\nBill To:\nInvoice 1\n12345") is None


def test_only_the_top_lines_are_looked_at(value):
    lines = ["Invoice page"] * 19
    assert value(invoice.issuer, "\n\n".join(lines + ["Acme"])) == "Acme"
    assert value(invoice.issuer, "\n\n".join(lines + ["total", "Acme"])) is None


def test_math_check(value):
    def check(text):
        return value(lambda c: invoice.math_check(c, invoice.total_value(c)), text)

    assert check("Subtotal: 100\nTax: 10 x\nTotal: 110 x") is True
    assert check("Subtotal: 100\nTax: 10 x\nTotal: 111 x") is False
    assert check("Tax ..... $50\nSubtotal: 100\nTotal: 150") is None
    assert check("Subtotal: ,\nTax: 10 x\nTotal: 110 x") is None
    assert check("Subtotal: 0\nTax: 10 x\nTotal: 10 x") is None


def test_empty_header_takes_the_next_line(value):
    assert value(lambda c: mail.email_header(c, "Subject"), "Subject:\nHello") == "Hello"


def test_neighbouring_addresses(value):
    assert value(mail.email_addresses, "a@b.co-x@y.com") == ["a@b.co", "-x@y.com"]
    assert value(mail.email_addresses, "a" * 200000) == []


def test_keys_need_three_characters_and_split_at_the_first_delimiter(value):
    pairs = value(forms.key_values, "ab: 1\nabc: 2\nwell-known: yes")
    assert [(p.question, p.answer) for p in pairs] == [("abc", "2"), ("well", "known: yes")]


def test_repeated_heading_keeps_the_last_body(value):
    text = "SKILLS\none\nSkills:\ntwo\nAWARDS\n\nEDUCATION -\nthree"
    assert value(resume.sections, text) == {"SKILLS": "two", "EDUCATION": "three"}
    assert value(resume.sections, "no headings") == {}


def test_names_skip_contact_lines(value):
    text = "Resume of X\ncv\nme@x.org\n555 123\n" + "y" * 61 + "\nJo Doe"
    assert value(resume.candidate_name, text) == "Jo Doe"


OCR = [
    ("a | b |c", "a I b Ic"),
    ("rn corner rnodern", "m comer rnodern"),
    ("avvay vv", "away vv"),
    ("h0use 0 10l2 l5", "hOuse 0 1012 15"),
    ("S 1,200 US 5", "$ 1,200 US 5"),
    ("a\f\n\n\n\nb", "a\n\nb"),
]


@pytest.mark.parametrize("text,expected", OCR)
def test_ocr_fixes(value, text, expected):
    assert value(tx.fix_ocr, text) == expected


def test_unicode_space(value):
    assert value(tx.word_count, "a b\x1cc　d") == 4
    assert value(tx.normalise_space, "  a \r\n b ") == "a b"
    assert value(tx.strip_space, " \n a b \x1f") == "a b"
    assert value(tx.normalise_space, None) == ""


def test_accents_split_words_and_repeats_stay(value):
    assert value(features.clean_tokens, "Café naïve, x2y") == ["caf", "na", "ve", "x", "y"]
    kept = value(lambda c: features.remove_stopwords(features.clean_tokens(c)), "the tax tax of don't")
    assert kept == ["tax", "tax"]


def test_bigrams_bridge_removed_words(value):
    assert value(features.terms, "Invoices for the companies") == [
        "invoice",
        "company",
        "invoice company",
    ]
    assert value(features.terms, "of a") == []


def test_term_counts(value):
    counts = value(lambda c: features.term_counts(F.split(c, " ")), "b a b")
    assert [(e.term, e.tf) for e in counts] == [("a", 1), ("b", 2)]
    assert value(lambda c: features.term_counts(F.array().cast("array<string>")), "") == []


def test_uncertain_is_strict_and_tiers_use_the_rounded_percent(spark):
    frame = spark.createDataFrame([(0.45,), (0.4496,), (0.7,)], "c double")
    pct = results.percent("c")
    rows = frame.select(results.is_uncertain("c"), pct, results.confidence_tier(pct)).collect()
    assert [tuple(r) for r in rows] == [(False, 45.0, "mid"), (True, 45.0, "mid"), (False, 70.0, "high")]


def test_summary_articles(spark):
    frame = spark.createDataFrame([("Invoice", 0.9), ("Resume", 0.9), ("Email", 0.1)], "l string, c double")
    shown = [r[0] for r in frame.select(results.summary("l", "c")).collect()]
    assert shown == ["This is an INVOICE.", "This is a RESUME.", "Uncertain — closest match is EMAIL."]


def test_ranking_keeps_class_order_on_ties(spark):
    shares = [F.lit(0.2), F.lit(0.3), F.lit(0.3), F.lit(0.2)]
    ranked = spark.range(1).select(results.rank_scores(["a", "b", "c", "d"], shares).alias("s")).first()["s"]
    assert [e.label for e in ranked] == ["b", "c", "a", "d"]


def test_percent_rounds_the_binary_value(spark):
    values = [0.1235, 0.1225, 0.00125, 0.98765, 0.0005]
    frame = spark.createDataFrame([(v,) for v in values], "c double")
    assert [r[0] for r in frame.select(results.percent("c")).collect()] == [
        round(v * 100, 1) for v in values
    ]


def test_suffix(value):
    cases = {"a/b.PDF": ".pdf", "a.b/c": "", ".hidden": "", "x.tar.gz": ".gz", "a/.b": "", "x.": ""}
    for path, expected in cases.items():
        assert value(tx.suffix, path) == expected


def test_language_names(value):
    assert value(language_name, "zh-cn") == "Chinese"
    assert value(language_name, "sv") == "SV"
    assert value(language_name, "unknown") == "UNKNOWN"
    assert value(is_non_english, "unknown") is False


def test_folds_never_drop_below_two():
    assert [fold_count(n) for n in (1, 2, 4, 9)] == [2, 2, 4, 5]
    assert wants_search(True, 20, 4) and not wants_search(True, 19, 4) and not wants_search(False, 99, 4)
