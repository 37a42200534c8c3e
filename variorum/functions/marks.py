"""Marks of punctuation: the sets that every operator shares."""

#: The 50 marks, and their groups.
MARKS = "。，、；：？！“”‘’‚„\"'（）《》【】「」『』〈〉〔〕〖〗:;,?!＂＇〝〞〟｢｣‹›«»·…—"
SENTENCE_END = "。？！?!"
INNER = "，、；：,;:"
QUOTES = "“”‘’\"'「」『』＂＇〝〞〟｢｣‚„‹›«»"
BRACKETS = "（）【】《》〈〉〔〕〖〗"
#: White space as Python's str.isspace() has it, and zero-width characters.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
ZERO_WIDTH = "".join(map(chr, [*range(0x200B, 0x2010), 0xFEFF, *range(0x2060, 0x2065)]))


def in_class(characters: str) -> str:
    """The characters as the inside of a regular expression's class, for Java and RE2 alike."""
    return "".join(f"\\x{{{ord(c):X}}}" for c in characters)


MARK = f"[{in_class(MARKS)}]"
NOT_MARK = f"[^{in_class(MARKS)}]"
SPACE = f"[{in_class(SPACES)}]"
LAYOUT = f"[{in_class(SPACES + ZERO_WIDTH)}]"

#: Letters and digits that are neither marks nor white space. Java tests a class's members beyond U+00FF one after the other,
#: so its classes below ask for these first; other engines take the plain ones above.
PLAIN = r"0-9A-Za-z\x{C0}-\x{24F}\x{3400}-\x{9FFF}"
J_MARK = f"[[^ \\n{PLAIN}]&&[{in_class(MARKS)}]]"
J_NOT_MARK = f"[^[^ \\n{PLAIN}]&&[{in_class(MARKS)}]]"
J_SPACE = f"[[^{PLAIN}]&&[{in_class(SPACES)}]]"
