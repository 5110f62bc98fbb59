import pytest

from millrace.sources.files import READERS
from tests.test_attachments import docx


@pytest.mark.parametrize("style, level", [("Heading 1", 1), ("Titre2", 2), ("Überschrift 3", 3), ("Kop 1", 1), ("Intestazione 2", 2), ("Título 4", 4), ("Encabezado1", 1), ("Cabeçalho 5", 5), ("Rubrik 6", 6), ("Overskrift 1", 1), ("Title", 1), ("Titel", 1), ("Tittel", 1), ("Sous-titre", 2), ("Subtitle", 2), ("Heading 7", 0), ("Kopf", 0), ("Normal", 0)])
def test_heading_styles(style, level):
    want = (0, "heading", f"{'#' * level} words") if level else (0, "text", "words")
    assert READERS["docx"](docx((style, "words"))) == [want]
