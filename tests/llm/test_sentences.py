"""Sentences: rules of a language only in its texts, marks with a context of any length."""

import pytest

from quarry.llm.sentences import ends, language


@pytest.mark.parametrize(
    ("text", "lang", "want"),
    [
        ("The answer is no. 5 people left.", "en", ["The answer is no.", "5 people left."]),
        ("Il sig. Rossi è arrivato. La riunione comincia.", "it", ["Il sig. Rossi è arrivato.", "La riunione comincia."]),
        ("Spotkanie o godz. 5. Potem idziemy do domu.", "pl", ["Spotkanie o godz. 5.", "Potem idziemy do domu."]),
        ("Dat zegt dhr. Jansen in het huis. Hij slaapt.", "nl", ["Dat zegt dhr. Jansen in het huis.", "Hij slaapt."]),
        ("Bkz. 3 ve devamı. Bu bir test.", "tr", ["Bkz. 3 ve devamı.", "Bu bir test."]),
        ("O Sr. Silva chegou. Ele não fala.", "pt", ["O Sr. Silva chegou.", "Ele não fala."]),
        # a sentence in another language brings that language's abbreviations
        ("Der Test ist nicht grün und die Zahl ist falsch. See Fig. 4 of the guide. Danach geht es weiter.", "de", ["Der Test ist nicht grün und die Zahl ist falsch.", "See Fig. 4 of the guide.", "Danach geht es weiter."]),
    ],
)
def test_language_tables(text, lang, want):
    assert [text[a:b] for a, b in ends(text, lang)] == want


def test_wrong_tag_gives_way_to_the_text():
    text = "Das ist die Regel, z. B. für den Fall. Sie gilt nicht."
    assert language(text, "en") == "de"
    assert ends(text, "en") == ends(text, "de") == ends(text, None)


def test_context_of_any_length():
    text = "x" * 100_000 + " " + "(" * 200 + "vgl. die Regel und das Wort. Der Rest ist da."
    assert len(ends(text, "de")) == 2
