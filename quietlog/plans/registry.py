"""All registered queries."""

from quietlog.plans import chat, flow, privacy, transcripts, usage

_PLANS = (usage, privacy, transcripts, chat, flow)
QUERIES = {name: fn for plan in _PLANS for name, fn in plan.QUERIES.items()}
ORACLE = {name: sql for plan in _PLANS for name, sql in plan.ORACLE.items()}
