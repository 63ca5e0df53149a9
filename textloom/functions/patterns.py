"""Character classes shared by the text columns.

Fixed values: the classes spell out what the text statistics count as white
space, word characters, upper case and digits.  They are written so that Java
and RE2 read them alike (no engine-specific ``\\w`` or ``\\s``).
"""

#: Unicode white space, body of a character class.
SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"
#: Letters, numbers and underscore, body of a character class.
WORD = r"\p{L}\p{N}_"
#: Letters with the Uppercase property.
UPPER = r"\p{Lu}\x{2160}-\x{216F}\x{24B6}-\x{24CF}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}"
#: Decimal digits plus the characters that carry a digit value.
DIGIT = (
    r"\p{Nd}\x{B2}\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
    r"\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}"
    r"\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}"
    r"\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}"
)
#: ASCII punctuation (32 characters), body of a character class.
ASCII_PUNCT = r"!-/:-@\[-`{-~"
#: Links: explicit scheme or a leading www.
URL = rf"(?i)https?://[^{SPACE}]+|www\.[^{SPACE}]+"
#: One run without sentence enders that holds some text.
SENTENCE_RUN = rf"[^.!?{SPACE}][^.!?]*"
#: A sentence with its ender.
CLOSED_SENTENCE = r"[^.!?]*[.!?]"
#: Word tokens of the count-based language model.
TOKEN = r"[\p{L}\p{M}\p{N}]+"
