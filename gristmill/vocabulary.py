"""Fixed values of the annotation model."""

#: Label axes and their order.
PRESENCE = ("NO_INSTRUCTION", "INSTRUCTION_PRESENT", "UNDETERMINED")
PRESENTATION = ("OPERATIVE", "QUOTED_OR_REPORTED", "HYPOTHETICAL", "UNKNOWN", "NOT_APPLICABLE")
ADDRESSEE = ("MODEL_OR_AGENT", "HUMAN", "EXTERNAL_SYSTEM", "UNKNOWN", "NOT_APPLICABLE")
GOAL_ALIGNMENT = ("ALIGNED", "MISALIGNED", "UNDETERMINED", "NOT_APPLICABLE")
POLICY_ALIGNMENT = ("COMPLIANT", "CONFLICTING", "UNDETERMINED", "NOT_APPLICABLE")
AUTHORITY = ("WITHIN_AUTHORITY", "OUTSIDE_AUTHORITY", "SPOOFED", "UNKNOWN", "NOT_APPLICABLE")
STATUS = ("CONFIRMED", "INSUFFICIENT_CONTEXT", "DISAGREEMENT", "EXCLUDED")
VERDICTS = ("NOT_DETECTED", "UNCERTAIN", "DETECTED")
SPAN_TYPES = ("DIRECTIVE", "INJECTION_PAYLOAD", "AUTHORITY_CLAIM")
DECISIONS = ("KEEP", "DROP_EXACT_DUPLICATE", "KEEP_VARIANT", "REVIEW")

#: Words that count as one, and words that don't count.
SYNONYMS = {
    "ignore": "ignore", "disregard": "ignore", "forget": "ignore",
    "previous": "previous", "prior": "previous", "earlier": "previous", "above": "previous",
    "instruction": "instruction", "instructions": "instruction", "direction": "instruction",
    "directions": "instruction", "rule": "instruction", "rules": "instruction",
}
FILLERS = ("all", "any", "the")

#: Thresholds of production and weights of the similarity.
SEMANTIC, VARIANT, REVIEW_BELOW, SEED = 0.72, 0.90, 0.85, 3202
WEIGHTS = (0.50, 0.25, 0.25)
