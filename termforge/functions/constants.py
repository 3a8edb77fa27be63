"""Fixed vocabularies of the text and query functions."""

#: Words that are never indexed.
STOPWORDS = tuple(
    """
a about above after again all also am an and any are as at be because been before being below between both but
by can could did do does during each few for from further get got had has have he her here him his how i if in
into is it its just may me might more most must my need no nor not of on only or other our out over own same
shall she should so some such than that the their them then there these they this those through to too under
until up very was we were what when where which while who whom why will with would you your
""".split()
)

#: Suffixes in the order they are tried, and what takes their place: the first one that leaves at least 3 letters wins.
STEM_RULES = tuple(
    (rule.split(">")[0], rule.split(">")[1])
    for rule in (
        "ational>ate tional>tion enci>ence anci>ance izer>ize alism>al ation>ate ator>ate ness> ment> ful> ous> ive> ize> "
        "ing> ies>y ally>al ently>ent eli>e ousli>ous ed> ly> er> es>e s>"
    ).split(" ")
)

#: A head word and its synonyms, the closest first. Where a synonym has several heads, the last one counts.
SYNONYMS = {
    line.split(": ")[0]: tuple(line.split(": ")[1].split())
    for line in """
fast: quick rapid speedy
big: large huge enormous
small: tiny little compact
good: great excellent fine
bad: poor terrible awful
start: begin launch initiate
end: finish complete terminate
make: create build construct
show: display present demonstrate
find: search locate discover
help: assist support aid
use: utilize employ apply
error: bug issue problem fault
fix: repair resolve patch
run: execute launch start
install: setup deploy configure
remove: delete uninstall erase
update: upgrade refresh patch
download: fetch retrieve get
upload: send push transfer
""".strip().splitlines()
}
HEADS = {word: head for head, words in SYNONYMS.items() for word in words}

#: Patterns of queries that want a place, tried first, and of queries that want to do something.
NAVIGATIONAL = r"^(?:go to |open |www\.|https?://)|(?:\.(?:com|org|net|io)| homepage| website| login| sign in)$"
TRANSACTIONAL = r"^(?:(?:buy|purchase|download|install|subscribe|order|book) |sign up)|(?: (?:price|cost|free|coupon))$"

TRACKING = ("utm_source", "utm_medium", "utm_campaign", "fbclid", "gclid")

MIN_TOKEN, MAX_TOKEN, MIN_TERM = 2, 40, 2
K1, B = 1.5, 0.75
ALPHA, BETA, GAMMA, CLICK_BOOST = 0.5, 0.2, 0.3, 0.05
DAMPING, TOLERANCE, ITERATIONS, BIAS = 0.85, 1e-6, 100, 0.3
SNIPPET, SNIPPETS, MARK = 200, 3, "**"
MAX_DEPTH, SEGMENT_DOCS, MERGE_FACTOR, SHARDS = 3, 1000, 10, 4
