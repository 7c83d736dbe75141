"""Word lists and patterns.  Fixed values: results depend on each of them."""

# Words by which texts are scored.
FUNCTION_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were be been being have has had do does did will "
    "would could should may might shall can not no nor so yet both either neither each that which who whom this these "
    "those it its they them their we our you your he she his her i my me"
).split()
HEDGES = (
    "furthermore moreover additionally consequently therefore nevertheless nonetheless however indeed certainly "
    "undoubtedly essentially fundamentally ultimately notably importantly significantly particularly specifically delve "
    "dive tapestry nuanced multifaceted comprehensive robust leverage utilize facilitate paradigm"
).split()
#: Entries of two words never match a single token; they are kept as they stand.
CASUALS = [
    "actually", "basically", "kind of", "sort of", "you know", "i mean", "well", "anyway", "stuff", "thing", "things",
    "pretty", "really", "just", "like", "though", "although", "but then", "so",
]
MORE_CASUALS = CASUALS + (
    "honestly somehow maybe probably guess kinda gonna gotta wanna ok okay cool weird lol haha omg btw tbh ngl imo"
).split()
FIRST_PERSON = "i me my myself mine".split()
FIRST_PERSON_WIDE = "i me my mine myself we us our ours".split()
CONTRACTIONS = (
    "don't doesn't didn't can't won't wouldn't shouldn't couldn't isn't aren't wasn't weren't haven't hasn't hadn't i'm "
    "i've i'll i'd we're we've we'll they're they've they'll you're you've you'll it's that's there's here's what's who's let's"
).split()

# The shorter lists of a demonstration scorer, and openings and auxiliaries that survive back-translation.
DEMO_HEDGES = (
    "additionally furthermore moreover consequently nevertheless specifically particularly significantly essentially fundamentally "
    "undeniably arguably notably importantly remarkably interestingly comprehensive innovative crucial robust leveraging utilizing "
    "enhancing facilitating delve tapestry multifaceted paradigm"
).split()
DEMO_CASUALS = "lol gonna wanna kinda yeah nah tbh imo btw idk omg haha hmm ok okay yep nope cuz tho ain't".split()
OPENINGS = "furthermore moreover additionally consequently therefore however".split()
AUXILIARIES = "was were is are been being".split()

# Signals of tone, as substrings of the lower-case text or the text, and as patterns.
CASUAL_TONE = "lol lmao tbh ngl idk omg haha gonna wanna kinda gotta".split()
CASUAL_MARKS = ["!!", "...", "??"]
CASUAL_PATTERN = r"\bi\b"
FORMAL_TONE = [
    "furthermore", "moreover", "consequently", "nevertheless", "subsequently", "therefore", "in conclusion",
    "as demonstrated", "significant", "approximately",
]
FORMAL_PATTERN = r"\bcite\b|\breference\b|\banalysis\b"

# Titles and headers that are stripped line by line, in this order.
TITLES = [
    r"^.*?\b(Essay|Report|Research Paper|Presentation|Assessment|Annotated Bibliography|Coursework|Dissertation|Case Study|Critical Writing|Term Paper)\b.*?\n+",
    r"^Table of Contents\n.*?\n\n",
    r"^\d+\.\s+[A-Z].*?\n",
    r"^(Introduction|Conclusion|Abstract|References|Bibliography)\s*\n",
]
HEADERS = [r"^#{1,6}\s+.*\n", r"^\*{3,}\s*\n", r"^-{3,}\s*\n", r"^\s*\d+\.\s+", r"^\s*[\*\-•]\s+"]

# Web boilerplate; a dot matches line ends too.
BOILERPLATE = [
    r"Subscribe to our newsletter.*", r"Click here to read more.*", r"Share this article.*", r"\[edit\]",
    r"Retrieved from.*", r"This article.*stub.*", r"===+", r"---+",
]

# Phrases by which a family of writers is recognised.
FAMILIES = {
    "gpt": [
        "Furthermore,", "Moreover,", "Additionally,", "Consequently,", "It's worth noting", "It is worth noting",
        "In conclusion,", "To summarize,", "As mentioned earlier", "This underscores", "Delve into", "Tapestry", "Nuanced",
        "Multifaceted", "Robust", "Leverage", "Paradigm", "Facilitate", "Utilize",
    ],
    "claude": [
        "I'd be happy to", "I'd be glad to", "I should mention", "I want to be clear", "I should note", "To be clear", "Let me",
        "I'll walk you through", "Here's", "Here are", "Happy to help", "Of course!", "Certainly!", "Absolutely!", "I notice",
        "I understand", "thoughtful", "nuanced perspective",
    ],
    "llama": [
        "Sure!", "Sure,", "Of course,", "Great question!", "I'm just an AI", "I'm a large language model",
        "As a language model", "As an AI assistant", "Note that", "Please note", "Important:",
    ],
    "human": [
        "actually", "basically", "you know", "kind of", "sort of", "honestly", "tbh", "imo", "idk", "btw", "lol", "omg",
        "anyway", "so yeah", "right?", "I mean", "like,", "stuff", "things", "pretty much", "I guess",
    ],
}
