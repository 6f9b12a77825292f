"""Per-language comment markers, branch keywords and declaration patterns. Fixed values."""

_C_MARKERS = dict(line=r"^\s*//", start=r"/\*", end=r"\*/")
_C_BRANCHES = [r"\bif\b", r"\belse\b", r"\bfor\b", r"\bwhile\b", r"\bcase\b", r"\bcatch\b", r"\b&&|\b\|\|", r"\bswitch\b"]

# `function` keeps the declaration's capturing groups; text in front of a declaration that does not change where matches end nor
# what the groups hold (repeated modifiers) is left out, since a repeated group makes the matcher recurse for every turn
# and long lines would overflow its stack. tests/test_blocks.py has a declaration with modifiers for each language.
LANGUAGES = {
    "java": dict(
        **_C_MARKERS, branches=_C_BRANCHES,
        function=r"(?:public|protected|private|static|\s)[\w\<\>\[\]]+\s+([a-zA-Z_]\w*)\s*\(([^)]*)\)\s*(?:throws\s+[\w,\s]+)?\s*\{", groups=2,
        klass=r"(?:class|interface|enum|record)\s+([a-zA-Z_]\w*)",
    ),
    "kotlin": dict(
        **_C_MARKERS, branches=[r"\bif\b", r"\belse\b", r"\bfor\b", r"\bwhile\b", r"\bwhen\b", r"\bcatch\b", r"\b&&|\b\|\|"],
        function=r"(?:fun|override\s+fun|suspend\s+fun)\s+(?:<[^>]+>\s+)?([a-zA-Z_]\w*)\s*\(([^)]*)\)", groups=2,
        klass=r"(?:class|interface|object|enum\s+class|data\s+class|sealed\s+class)\s+([a-zA-Z_]\w*)",
    ),
    "javascript": dict(
        **_C_MARKERS, branches=_C_BRANCHES,
        function=r"(?:async\s+)?function\s*([a-zA-Z_]\w*)?\s*\(([^)]*)\)|(?:const|let|var)\s+([a-zA-Z_]\w*)\s*=\s*(?:async\s+)?\(([^)]*)\)\s*=>|([a-zA-Z_]\w*)\s*\(([^)]*)\)\s*\{", groups=6,
        klass=r"class\s+([a-zA-Z_]\w*)",
    ),
    "typescript": dict(
        **_C_MARKERS, branches=_C_BRANCHES,
        function=r"(?:async\s+)?(?:public|private|protected|static\s+)?function\s*([a-zA-Z_]\w*)?\s*\(([^)]*)\)|(?:const|let|var)\s+([a-zA-Z_]\w*)\s*=\s*(?:async\s+)?\(([^)]*)\)\s*(?::\s*[^=]+)?\s*=>|([a-zA-Z_]\w*)\s*\(([^)]*)\)\s*(?::\s*[^\{]+)?\s*\{", groups=6,
        klass=r"(?:class|interface|type|enum)\s+([a-zA-Z_]\w*)",
    ),
    "go": dict(
        **_C_MARKERS, branches=[r"\bif\b", r"\belse\b", r"\bfor\b", r"\bcase\b", r"\bselect\b", r"\b&&|\b\|\|"],
        function=r"func\s*(?:\([^)]+\)\s*)?([a-zA-Z_]\w*)\s*\(([^)]*)\)", groups=2,
        klass=r"type\s+([a-zA-Z_]\w*)\s+struct",
    ),
    "rust": dict(
        **_C_MARKERS, branches=[r"\bif\b", r"\belse\b", r"\bfor\b", r"\bwhile\b", r"\bmatch\b", r"\bloop\b", r"\b&&|\b\|\|"],
        function=r"(?:pub\s+)?(?:async\s+)?fn\s+([a-zA-Z_]\w*)\s*(?:<[^>]+>)?\s*\(([^)]*)\)", groups=2,
        klass=r"(?:pub\s+)?(?:struct|enum|trait|impl(?:\s*<[^>]+>)?)\s+([a-zA-Z_]\w*)",
    ),
    "cpp": dict(
        **_C_MARKERS, branches=_C_BRANCHES,
        function=r"[\w\<\>:]\s+([a-zA-Z_]\w*)\s*\(([^)]*)\)\s*(?:const)?\s*\{", groups=2,
        klass=r"(?:class|struct)\s+([a-zA-Z_]\w*)",
    ),
    "c": dict(
        **_C_MARKERS, branches=[r"\bif\b", r"\belse\b", r"\bfor\b", r"\bwhile\b", r"\bcase\b", r"\b&&|\b\|\|", r"\bswitch\b"],
        function=r"[\w\*]\s+([a-zA-Z_]\w*)\s*\(([^)]*)\)\s*\{", groups=2,
        klass=r"struct\s+([a-zA-Z_]\w*)",
    ),
    "ruby": dict(
        line=r"^\s*#", start=r"=begin", end=r"=end",
        branches=[r"\bif\b", r"\belsif\b", r"\belse\b", r"\bunless\b", r"\bwhile\b", r"\buntil\b", r"\bfor\b", r"\bcase\b", r"\brescue\b"],
        function=r"def\s+([a-zA-Z_]\w*[!?=]?)(?:\s*\(([^)]*)\))?", groups=2,
        klass=r"(?:class|module)\s+([a-zA-Z_]\w*)",
    ),
}
# Any language without an entry above: comments of both styles, few branches, no declarations.
OTHER = dict(line=r"^\s*(?://|#)", start=r"/\*", end=r"\*/", branches=[r"\bif\b", r"\bfor\b", r"\bwhile\b"], function=None, groups=0, klass=None)

# Java text patterns of the regex extractor.
JAVA_METHOD = r"[\w<>\[\],?]\s+(\w+)\s*\(([\s\S]*?)\)\s*(?:throws\s+[\w,\s]+)?\s*\{"
JAVA_CLASS = r"(?:class|interface|enum|record)\s+\w+"
JAVA_IMPORT = r"(?m)^\s*import\s+"
JAVA_DECISION = r"\b(?:if|else\s+if|for|while|case|catch)\b|&&|\|\|"
JAVA_NESTING = r"\b(?:if|else\s+if|else|for|while|do|switch|try|catch|finally|synchronized)\b"
JAVA_JUMPS = r"\b(?:break|continue|return|throw)\b"
OPERATORS = r"[+\-*/=<>!&|^~%?:]+"
IDENTIFIERS = r"\b[a-zA-Z_]\w*\b"
JAVA_KEYWORDS = [
    "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char", "class",
    "const", "continue", "default", "do", "double", "else", "enum", "extends", "final",
    "finally", "float", "for", "goto", "if", "implements", "import", "instanceof", "int",
    "interface", "long", "native", "new", "null", "package", "private", "protected",
    "public", "record", "return", "sealed", "short", "static", "strictfp", "super",
    "switch", "synchronized", "this", "throw", "throws", "transient", "try", "var",
    "void", "volatile", "while", "true", "false",
]

PYTHON_KEYWORDS = [
    "False", "None", "True", "and", "as", "assert", "async", "await", "break", "class", "continue", "def", "del", "elif", "else",
    "except", "finally", "for", "from", "global", "if", "import", "in", "is", "lambda", "nonlocal", "not", "or", "pass", "raise",
    "return", "try", "while", "with", "yield",
]

# Python by indentation and text; stands in for a syntax tree.
PYTHON_DEF = r"^\s*(?:async\s+)?def\s+\w+"
PYTHON_CLASS = r"^\s*class\s+\w+"
PYTHON_IMPORT = r"(?m)^\s*(?:import|from)\s+\w"
PYTHON_BRANCH = r"\b(?:if|elif|for|while|except|and|or)\b"
PYTHON_HEADER = r"^\s*(?:async\s+)?(if|elif|else|for|while|with|try|except|finally|def)\b"
PYTHON_BOOLEAN = r"\b(?:and|or)\b"
