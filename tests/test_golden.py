"""Known answers for one document of each class; every line is indented, which matters."""

from foliospark.functions import forms, invoice, mail, resume

INVOICE = """
    Blue Harbour Ltd
    Invoice Number: BH-20871
    Date: 09/11/2025
    Due Date: Dec 9, 2025

    Repairs .............. $820.00
    Tax .................. $80.00
    Total: $900.00
    """

EMAIL = """
    From: Ada Byron <ada.byron@example.com>
    To: Carl Gauss <cgauss@uni.example.org>
    Date: May 3, 2025 09:15
    Subject: Minutes of the meeting

    The minutes are attached. Questions go to office@example.com.
    """

FORM = """
    PATIENT QUESTIONNAIRE
    Name: Maria Curie
    Email: maria.curie@example.com

    1) Are you taking any medicine?
    Yes - aspirin

    2. How should we reach you:
    [x] Letter
    [ ] Phone
    ( ) Visit
    """

RESUME = """
    Emmy A. Noether
    emmy@example.com  |  +1 (555) 987-6543
    https://www.example.com/in/emmy-noether

    EDUCATION
    Doctorate, Example University

    EXPERIENCE
    Lecturer, Example Institute
    """


def unindented(text):
    return "\n".join(line.strip() for line in text.splitlines())


def test_invoice(value):
    fields = value(invoice.invoice_fields, INVOICE)
    assert fields.asDict() == {
        "invoice_number": "BH-20871",
        "invoice_date": "09/11/2025",
        "due_date": "Dec 9, 2025",
        "issuer_name": "Blue Harbour Ltd",
        "recipient_name": None,
        "total_amount": "900.00",
        "validation_math_passed": None,
    }
    assert value(invoice.all_dates, INVOICE) == ["09/11/2025", "Dec 9, 2025"]
    assert value(invoice.total_amount, INVOICE) == "900.00"


def test_email_headers_need_the_first_column(value):
    assert value(lambda c: mail.email_header(c, "From"), EMAIL) is None
    assert value(lambda c: mail.email_header(c, "Subject"), EMAIL) is None
    addresses = ["ada.byron@example.com", "cgauss@uni.example.org", "office@example.com"]
    assert value(mail.email_addresses, EMAIL) == addresses
    plain = value(mail.email_fields, unindented(EMAIL))
    assert plain.sender == "Ada Byron <ada.byron@example.com>"
    assert plain.recipient == "Carl Gauss <cgauss@uni.example.org>"
    assert plain.date == "May 3, 2025 09:15"
    assert plain.subject == "Minutes of the meeting"


def test_questionnaire(value):
    found = value(forms.form_fields, FORM)
    assert found.questions == [
        "1) Are you taking any medicine?",
        "Are you taking any medicine?",
        "How should we reach you:",
    ]
    assert [(b.label, b.checked) for b in found.checkboxes] == [
        ("Letter", True),
        ("Phone", False),
        ("Visit", False),
    ]
    assert [(p.question, p.answer) for p in found.key_values] == [
        ("Name", "Maria Curie"),
        ("Email", "maria.curie@example.com"),
        ("Yes", "aspirin"),
        ("2. How should we reach you", "[x] Letter"),
    ]


def test_resume(value):
    found = value(resume.resume_fields, RESUME)
    assert found.name == "Emmy A. Noether"
    assert found.email == "emmy@example.com"
    assert found.phone == "+1 (555) 987-6543"
    assert found.links == ["https://www.example.com/in/emmy-noether"]
    assert found.sections == {
        "EDUCATION": "Doctorate, Example University",
        "EXPERIENCE": "Lecturer, Example Institute",
    }
