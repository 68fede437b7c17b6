"""Values that must stay equal to the data they were published with.

Prompt templates, tag names, cleanup patterns and defaults are part of the
data contract: tables built with other values are not interchangeable.
"""

# ---- fixed values: defaults -------------------------------------------------
POSITIONS_PER_DOC = 10
SEED = 42
MIN_POSITION = 50
MAX_LENGTH = 2048
SPLIT_FRACTIONS = (0.25, 0.25, 0.50)
CHUNK_ROWS = 512
MIN_FEATURES = 2
SAMPLES_PER_PROMPT = 4
KL_COEF = 0.01
FAILED_EXTRACTION_REWARD = -2.0
ADVANTAGE_STD_FLOOR = 1e-8
NORM_FLOOR = 1e-12
IGNORED_LABEL = -100
INJECTION_SCALE_FACTOR = 2.5
PREVIEW_CHARS = 200
TAIL_CHARS = 120

# ---- fixed values: tags and placeholders ------------------------------------
INJECT_PLACEHOLDER = "<INJECT>"
EXPLANATION_OPEN = "<explanation>"
EXPLANATION_CLOSE = "</explanation>"
ANALYSIS_OPEN = "<analysis>"
ANALYSIS_CLOSE = "</analysis>"

# ---- fixed values: reasons a label attempt is dropped ------------------------
DROP_NO_COMPLETION = "provider returned None (retries exhausted)"
DROP_NO_MATCH = "extract pattern did not match"
DROP_TOO_FEW = "too few features ({count} < {minimum})"

# ---- fixed values: prompt templates -----------------------------------------
ACTOR_TEMPLATE = (
    "You are a meticulous AI researcher conducting an important investigation "
    "into activation vectors from a language model. Your overall task is to "
    "describe the semantic content of that activation vector.\n\n"
    "We will pass the vector enclosed in <concept> tags into your context. "
    "You must then produce an explanation for the vector, enclosed within "
    "<explanation> tags. The explanation consists of 2-3 text snippets "
    "describing that vector.\n\n"
    "Here is the vector:\n\n"
    "<concept>{injection_char}</concept>\n\n"
    "Please provide an explanation."
)
CRITIC_TEMPLATE = "Summary of the following text: <text>{explanation}</text> <summary>"
INSTRUCTION_TEMPLATE = """A language model needs to predict what text comes next after a snippet which will be presented to you shortly. Identify the 2-3 most important features it would use for this prediction.
Focus on what the language model must be "thinking about" at the point where the provided text ends. You should not need to reference the fact that the text is truncated/incomplete/a prefix: the language model is causal, so only sees the prefix to what it predicts and this is implicit.
Order features by what is most important for predicting the next tokens. Each feature should consist of a concise ~10-20 word description. Feel free to include specific textual examples inline.

Feature types to consider (as inspiration, not a rigid checklist):
- Syntactic/structural constraints: "unclosed parenthesis requires matching close"
- Immediate semantic expectations: "list promised three items but only two given"
- Stylistic/register patterns: "formal academic tone maintained throughout"
- Narrative/argumentative momentum: "thesis stated, supporting evidence now expected"
- Domain/genre signals: "medical case history following SOAP format"
- Repetition/continuation patterns: "same phrase structure repeating with variations"

The final feature must describe the very end of the presented sequence: its role, what it's part of, and immediate constraints on what follows.

Format — IMPORTANT: keep to ~80-100 words total and ALWAYS close the tag. Separate each feature with a blank line (press Enter twice between features):
<analysis>
[first feature — include specific examples when relevant]

[second feature]

[final feature: the last token, its role, immediate constraints]
</analysis>

Text to analyze:

<begin_text>{text}<end_text>"""

# ---- fixed values: characters and patterns ----------------------------------
# White space as Unicode defines it plus the four ASCII separators, spelled out
# because regex engines disagree about \s.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = f"[{WHITESPACE}]"
TOKEN_PATTERN = "[ \n\t\r]*[^ \n\t\r]+"
LIST_MARKER_PATTERN = (
    f"^{WS}*(?:"
    r"[-*•+–—]"
    r"|\p{Nd}+[.)]"
    r"|\(\p{Nd}+\)"
    r"|[a-zA-Z][.)]"
    r"|\([a-zA-Z]\)"
    r"|[ivxIVX]+[.)]"
    f"){WS}+"
)
LEADING_BOLD_PATTERN = rf"^\*\*([^\n]+?)\*\*{WS}*"
ANALYSIS_PATTERN = f"(?s){ANALYSIS_OPEN}{WS}*(.*?){WS}*{ANALYSIS_CLOSE}"
EXPLANATION_PATTERN = f"(?s){EXPLANATION_OPEN}(.*?){EXPLANATION_CLOSE}"
