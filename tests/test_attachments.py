"""Attachments of mails go through the reader table."""

import email.message
import io
import zipfile

from millrace.sources import files

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def mail(subject, *attached):
    m = email.message.EmailMessage()
    m["Subject"] = subject
    m.set_content(f"Body of {subject}.")
    for name, data in attached:
        m.add_attachment(data, maintype="application", subtype="octet-stream", filename=name)
    return m.as_bytes()


def docx(*paragraphs):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>' + "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs) + "</w:body></w:document>")
    return out.getvalue()


def test_attachments_use_the_readers(spark, tmp_path):
    deep = mail("m0", ("last.txt", b"the last text"))
    for i in range(1, 6):
        deep = mail(f"m{i}", ("inner.eml", deep))
    parts = [("a.docx", docx(("Normal", "office text"))), ("b.html", b"<p>page text</p>"), ("c.pdf", b"plugged"), ("d.docx", b"broken"), ("e.bin", b"123"), ("f.eml", deep)]
    (tmp_path / "m.eml").write_bytes(mail("top", *parts))
    rows = files.documents(spark, str(tmp_path), readers={"pdf": lambda raw: [(3, "text", raw.decode() + " in")]}).collect()
    got = {(r.page, r.kind, r.text) for r in rows}
    assert (1000, "text", "[attachment:a.docx]\noffice text") in got
    assert (2000, "text", "[attachment:b.html]\npage text") in got
    assert (3003, "text", "[attachment:c.pdf]\nplugged in") in got
    assert [r.kind for r in rows if "[attachment:d.docx]" in r.text] == ["error"]
    assert (5000, "attachment", "[attachment:e.bin]\n3 bytes") in got
    assert any(r.text.endswith("the last text") and r.text.count("inner.eml") == 5 for r in rows)
