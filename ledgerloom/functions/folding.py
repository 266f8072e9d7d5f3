"""Plain-form folding of short strings (values, units, labels) before they are parsed."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Letters of other scripts that look like a Latin one.
CYRILLIC_LOOKS = dict(zip("АВСЕНІЈКМОРЅТУХҮԚԜасеһіјкорѕухԁԛԝ", "ABCEHIJKMOPSTYXYQWacehijkopsyxdqw", strict=True))
GREEK_LOOKS = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχϲ", "ABEZHIKMNOPTYXaikvopuxc", strict=True))
ARMENIAN_LOOKS = dict(zip("ԼՍՕոսհզցօ", "LUOnuhqgo", strict=True))
CHEROKEE_LOOKS = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ", strict=True))
COPTIC_LOOKS = dict(zip("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲭⲟⲣⲥ", "HIKMNOPCTxopc", strict=True))
LOOKS = {**CYRILLIC_LOOKS, **GREEK_LOOKS, **ARMENIAN_LOOKS, **CHEROKEE_LOOKS, **COPTIC_LOOKS}

# Invisible characters outside category Cf.
INVISIBLE_EXTRA = "͏ᅟᅠ឴឵ㅤﾠ"


def is_invisible(ch: str) -> bool:
    """Characters without a glyph or width: format characters, fillers and variation selectors."""
    point = ord(ch)
    return (
        unicodedata.category(ch) == "Cf"
        or ch in INVISIBLE_EXTRA
        or 0xFE00 <= point <= 0xFE0F
        or 0xE0100 <= point <= 0xE01EF
    )


@lru_cache(maxsize=1 << 14)
def _fold_char(ch: str) -> str:
    if is_invisible(ch):
        return ""
    if unicodedata.category(ch) == "Zs":
        return " "
    return LOOKS.get(ch, ch)


@lru_cache(maxsize=1 << 16)
def fold(text: str) -> str:
    """Compatibility form without invisible characters, with plain spaces and Latin letters for look-alikes."""
    if text.isascii():
        return text
    seen = "".join(map(_fold_char, text))
    return "".join(map(_fold_char, unicodedata.normalize("NFKC", seen)))
