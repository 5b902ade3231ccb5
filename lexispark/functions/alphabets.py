"""Letter tables."""

# Letters that mark a Vietnamese text.
VIETNAMESE_MARKED = (
    "àáảãạâầấẩẫậăằắẳẵặ"
    "èéẻẽẹêềếểễệòóỏõọ"
    "ìíỉĩịôồốổỗộơờớởỡợ"
    "ùúủũụưừứửữựỳýỷỹỵđ"
)
# Vowels with and without marks, and consonants foreign to Vietnamese.
VOWELS_MARKED = "àáảãạâầấẩẫậăằắẳẵặèéẻẽẹêềếểễệòóỏõọìíỉĩịôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ"
VOWELS_PLAIN = "aeoiuy"
FOREIGN_CONSONANTS = "fjwz"
# Characters that may open a sentence (used inside a character class).
SENTENCE_START = r"A-ZĐÀÁẢÃẠẤẦẨẪẬƯỪỨỬỮỰÙÚỦŨỤÔỒỐỔỖỘƠỜỚỞỠỢÈÉẺẼẸÊỀẾỂỄỆÌÍỈĨỊỲÝỶỸỴ0-9"

# Accented letters of French, German and Spanish, for corpora in those languages.
WEST_EUROPEAN_MARKED = "àâäáçéèêëîïíñôöóœùûüúÿß"

_BASES = {
    "a": "àáảãạâầấẩẫậăằắẳẵặ",
    "e": "èéẻẽẹêềếểễệ",
    "o": "òóỏõọôồốổỗộơờớởỡợ",
    "i": "ìíỉĩị",
    "u": "ùúủũụưừứửữự",
    "y": "ỳýỷỹỵ",
    "d": "đ",
}
# Arguments of translate(): marked letter by letter, then its base.
MARKED_FROM = "".join(_BASES.values())
MARKED_TO = "".join(base * len(marked) for base, marked in _BASES.items())
