"""All queries of the subpackage; importing this registers them."""
from veilframe.llm import chats, exact, mixing, negatives, personal, phrases, pieces, quality, recurrent, revisits, secrets, simhash, toxicity  # noqa: F401
from veilframe.llm.registry import CHECKS, QUERIES  # noqa: F401
