"""Vocabularies, word lists, patterns and weights that define results."""

# Entity and edge vocabularies.
ENTITY_TYPES = [
    "person", "team", "project", "product", "system", "workflow", "incident",
    "deployment", "customer", "department", "document", "decision", "metric", "tool",
]
EDGE_TYPES = [
    "owns", "depends_on", "caused", "related_to", "assigned_to", "part_of",
    "blocked_by", "affects", "manages", "deployed_to", "escalated_to", "discussed_in",
]
EVENT_TYPES = [
    "deployment", "incident", "outage", "escalation", "release", "onboarding_issue",
    "support_spike", "customer_complaint", "infrastructure_failure", "workflow_change",
    "security_event", "decision", "migration", "rollback", "performance_issue",
]
EVENT_EDGE_TYPES = [
    "caused_by", "triggered_by", "affects", "escalated_to", "resolved_by",
    "related_to", "occurred_after", "occurred_before",
]
SEVERITIES = ["low", "medium", "high", "critical"]
WORKFLOW_ACTIVE_STATES = ["pending_review", "blocked", "in_progress", "escalated"]

DEFAULT_WORKSPACE = "default_workspace"

# Source kind by source name.
SOURCE_TYPES = {"slack": "chat_thread", "notion": "wiki_page", "jira": "ticket"}

# Dictionary words of the tagger, per entity type.
TEAM_WORDS = ["engineering", "product", "qa", "support", "devops", "ops", "marketing", "sales", "hr", "finance", "design"]
SYSTEM_WORDS = [
    "postgres", "postgresql", "qdrant", "aws", "s3", "docker", "kubernetes", "fastapi",
    "ollama", "sentence-transformers", "github", "jira",
]
ENVIRONMENT_WORDS = ["production", "prod", "staging", "dev", "development", "localhost", "test"]
PRODUCT_WORDS = ["notion", "slack", "stripe"]
CONCEPT_WORDS = ["deployment", "migration", "onboarding", "backup", "postmortem", "runbook", "sprint"]
# Callers add their own project names; one site-specific name is not shipped.
PROJECT_WORDS = ["apollo", "phoenix", "nexus", "aurora", "copilot"]

# Tagger patterns.
PROJECT_PATTERN = r"(?i)\bproject[-_ ]([a-zA-Z0-9_\-]+)\b"
INCIDENT_PATTERN = r"(?i)\b(inc[-_ ][0-9]+|incident[-_ ][0-9]+|outage|sev[-_ ][0-9])\b"
MENTION_PATTERN = r"@([a-zA-Z0-9_.\-]+)"
WORD_PATTERN = r"\b[a-zA-Z0-9_\-]+\b"

# Chunk classifier, first matching row wins, plain substrings.
CHUNK_EVENT_WORDS = [
    ("incident", ["incident", "outage", "sev-", "severity", "downtime", "postmortem", "incident report", "rca", "incident-"]),
    ("deployment", ["deployment", "deploy", "release", "released", "shipped", "production push", "rollback", "migration"]),
    ("meeting", ["meeting", "sync", "standup", "retro", "retrospective", "weekly", "all-hands", "kickoff"]),
    ("escalation", ["escalation", "escalate", "escalated", "paged", "pagerduty", "alert", "pager"]),
]
TEAM_NAMES_IN_EVENTS = ["Engineering", "Product", "Support", "Devops"]

# Line classifier, first matching row wins.
LINE_EVENT_PATTERNS = [
    ("outage", r"\b(outage|downtime|system down|unreachable|service down|offline|crash|db crash)\b"),
    ("rollback", r"\b(rollback|rolled back|revert)\b"),
    ("deployment", r"\b(deploy|deployment|deployed|rollout|updated production|shipped)\b"),
    ("migration", r"\b(migration|migrated|schema upgrade|db upgrade|db migration)\b"),
    ("incident", r"\b(incident|inc[-_ ][0-9]+|bug|alert|exception|error|prod alert|sev[-_ ][0-9])\b"),
    ("escalation", r"\b(escalated|paged|page|alerted oncall|notified lead)\b"),
    ("release", r"\b(release|released|v[0-9]+\.[0-9]+)\b"),
    ("security_event", r"\b(security|vulnerability|cve|leak|rotated key|breach)\b"),
    ("performance_issue", r"\b(latency|slow|memory leak|high cpu|high memory|timeout|throttling|cpu spike)\b"),
    ("decision", r"\b(decided|decision|choice|opted to|we will use|adr)\b"),
]
LINE_DATE_PATTERN = r"\b(20\d{2}[-/]\d{2}[-/]\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?)?)\b"

# Query profiles in tie order, with keywords and explanations.
QUERY_PROFILES = [
    ("root_cause_analysis",
     ["why", "root cause", "reason", "because", "cause", "triggered", "after release", "rollback", "failed due to"]),
    ("recurring_issue",
     ["recurring", "repeated", "rising", "again", "frequent", "often", "frequently", "repeatedly"]),
    ("trend_analysis",
     ["trend", "progression", "increasing", "worsening", "over time", "history", "month", "days", "growth"]),
    ("escalation_analysis",
     ["escalation", "escalate", "alert", "pagerduty", "severity", "sev", "paged", "on-call"]),
    ("bottleneck_analysis",
     ["bottleneck", "delay", "blocked", "slow", "onboarding", "pipeline", "wasting time", "worsening delay"]),
    ("timeline_analysis",
     ["timeline", "sequence", "chronology", "history", "when", "first", "then", "followed by", "progression"]),
    ("anomaly_investigation",
     ["anomaly", "unusual", "spike", "outage", "leak", "failure", "jump", "outlier", "sudden"]),
]

# Months by number.
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4,
    "may": 5, "june": 6, "jun": 6, "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9,
    "sep": 9, "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}

# Words that never name an affected entity.
GENERIC_ENTITIES = ["discussion", "incident", "deployment", "slack", "notion", "production", "environment"]

# Title words that do not open an issue cluster.
TITLE_STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "with", "by", "of", "from",
    "release", "version", "chat:", "issue", "report:", "api", "slack", "notion", "jira", "webhook",
    "error", "warning", "info", "alert",
]
TITLE_PUNCTUATION = ":,.-()[]{}'\""
BILLING_KEYWORDS = ["billing", "payment", "stripe", "webhook"]
DATABASE_KEYWORDS = ["db", "postgres", "database", "pool"]

# Issue types per detector.
ISSUE_TYPES = ["incident", "outage", "performance_issue", "infrastructure_failure"]
RECURRING_TYPES = ["incident", "escalation"]
CHAIN_TYPES = ["incident", "escalation", "discussion"]
STABILITY_TYPES = ["incident", "outage", "abnormal_incident_frequency"]
BOTTLENECK_TYPES = ["incident", "outage", "performance_issue"]
SPIKE_HIGH_TYPES = ["outage", "incident", "security_event"]
SUPPORT_TYPES = ["support_spike", "customer_complaint"]

# Alert level to severity.
ALERT_SEVERITY = {"fatal": "critical", "error": "high", "warning": "medium", "info": "low", "debug": "low"}

# Ranking weights.
RECENCY_WEIGHT = 0.12
RECENCY_DECAY = 0.01
HIERARCHY_WEIGHT = 0.15
ENTITY_WEIGHT = 0.15
SOURCE_WEIGHTS = {"notion": 0.05, "slack": 0.0, "unknown": 0.0}

# Correlation weights and thresholds.
CORRELATION_THRESHOLD = 0.65
CORRELATION_NEIGHBOURS = 10

# Entity resolution thresholds.
JACCARD_THRESHOLD = 0.80
NAME_COSINE_THRESHOLD = 0.92

FREE_PLAN_DOCUMENTS = 50
