"""Folding of text to plain lower-case letters, so that ways of writing the same words become equal."""

from __future__ import annotations

import re
import unicodedata

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    {
        "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
        "А": "a", "В": "b", "С": "c", "Е": "e", "Н": "h", "І": "i", "Ј": "j", "К": "k", "М": "m", "О": "o", "Р": "p", "Ѕ": "s", "Т": "t", "Х": "x", "У": "y",
        "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y",
        "Α": "a", "Β": "b", "Ε": "e", "Ζ": "z", "Η": "h", "Ι": "i", "Κ": "k", "Μ": "m", "Ν": "n", "Ο": "o", "Ρ": "p", "Τ": "t", "Υ": "y", "Χ": "x",
        "ı": "i", "ł": "l", "đ": "d", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "ɑ": "a", "ɡ": "g", "ʟ": "l",
    }
)

_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿￹-￻]")
_MARKS = re.compile("[̀-ͯ҃-҇᪰-᫿᷀-᷿⃐-⃿]")


def fold(text: str) -> str:
    """Lower case without accents, invisible characters and letters that only look like Latin ones."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text).translate(LOOKALIKES))
    return _MARKS.sub("", text).lower().translate(LOOKALIKES)
