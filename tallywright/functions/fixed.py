"""Word lists, patterns and constants that define the default study; every operator takes its own instead."""

# --- fixed values: name grammar -----------------------------------------------------------------
COMPOUND_SUFFIXES = [
    "cli", "core", "tools", "utils", "sdk", "client", "server",
    "plugin", "hotfix", "cloud", "test", "testing", "dev",
    "config", "api", "extension", "language-server", "language",
]
COMPOUND_PREFIXES = [
    "py", "node", "react", "vue", "aws", "azure", "google", "dagster",
    "pandas", "django", "flask", "express",
]
TREND_SUFFIXES = ["turbo", "pro", "plus", "ai", "ml", "premium", "enterprise", "max"]
FAMILY_AFFIXES = [
    "turbo", "pro", "plus", "ai", "ml", "helper", "utils", "util",
    "core", "lib", "sdk", "cli", "tool", "tools", "kit", "js", "py",
]

# --- fixed values: mechanism patterns, by category, in order ----------------------------------------
MECHANISMS = {
    "obfuscated_payload_execution": [
        r"(base64|gzip|zlib)[\w\s/-]{0,40}decod\w*.{0,80}(exec|eval|compile)\s*\(",
        r"(exec|eval)\s*\(\s*compile\s*\(",
        r"decoded (bytes|payload|literal).{0,40}(exec|eval)",
        r"obfuscator\.io",
        r"string[- ]array\s+(accessor|obfuscat)",
        r"rotating\s+\d+[- ]entry\s+string\s+array",
    ],
    "hidden_install_hook": [
        r"setup\.py\s+defines?\s+a\s+custom\s+install",
        r"custom\s+install\s+command",
        r"cover[- ]story\s+names?",
        r"mimick?ing\s+native[- ]extension\s+setup",
        r"runs?\s+on\s+pip\s+install",
        r"(pre|post)install\s+(hook|script)",
        r"runs?\s+on\s+npm\s+install",
    ],
    "credential_or_wallet_exfiltration": [
        r"exfiltrat\w*\s+.{0,60}(env(iron)?(ment)? variabl|credential|secret|token|\.aws|\.ssh)",
        r"(wallet|crypto\w*)\s+(directories|files|keys?)\s+(are\s+)?(collect|steal|harvest)\w*",
        r"(steal|harvest)\w*\s+.{0,40}(credential|wallet|token|secret)",
        r"(read|collect|send|post|beacon)\w*\s+.{0,60}(env(iron)?(ment)? variabl|hostname|credential|\.env)\w*.{0,60}(POST|GET|beacon|hardcoded|collector|endpoint)",
        r"embeds?\s+.{0,40}(hostname|username|IP)\s+.{0,40}(subdomain|DNS|query param)",
        r"(POST|post)\w*\s+.{0,80}(to\s+a\s+)?(hardcoded|collector|endpoint|webhook)",
    ],
    "remote_backdoor_access": [
        r"(flask|http)\s+server\s+bound\s+to\s+0\.0\.0\.0",
        r"persistence\s+via\s+(registry|cron|systemd|scheduled task)",
        r"establish\w*\s+persistence",
        r"backdoor",
        r"reverse[- ]shell",
    ],
    "remote_payload_retrieval": [
        r"download\w*\s+.{0,40}(and\s+)?execut\w*\s+.{0,30}(remote|second[- ]stage)",
        r"download\w*\s+.{0,40}remote\s+executable",
        r"second[- ]stage\s+payload",
    ],
    "brand_impersonation_narrative": [
        r"(closely\s+)?mimic\w*\s+.{0,60}legitimate",
        r"impersonat\w*",
        r"single[- ]character\s+substitution",
        r"fabricated\s+.{0,30}branding",
    ],
}
INSTRUCTIONS = {
    "direct_instruction_override": [
        r"ignore (all |any )?(previous|prior|above) instructions",
        r"disregard (your |the )?(system prompt|previous instructions)",
        r"forget (your |all )?(previous|prior) (instructions|rules)",
    ],
    "system_prompt_impersonation": [
        r"\[system\]",
        r"\[SYSTEM\]",
        r"you are now (in |a )?(developer mode|unrestricted)",
        r"###\s*(system|developer) (prompt|instructions)",
    ],
    "tool_use_manipulation": [r"call the \w+ tool", r"invoke (the )?\w+ tool with", r"use your (shell|bash|execute|file) tool to"],
    "data_exfiltration_instruction": [
        r"\b(?:send|post|upload|exfiltrat|steal|harvest)\w*\s+.{0,40}(credentials|env(iron)?(ment)? variables?|secrets|api[_ ]?keys?|\.aws|\.ssh|tokens?)",
    ],
    "external_resource_retrieval": [
        r"\b(?:download|fetch|curl|wget)\w*\s+.{0,60}(and\s+)?\b(?:execut|run|eval)\w*\b",
        r"(curl|wget)\s+http.{0,80}\|\s*(sh|bash|python)",
    ],
    "unauthorized_execution_instruction": [
        r"\b(?:silent|covert|secret)\w*\s+(?:run|execut|install)\w*",
        r"\b(?:run|execut)\w*\s+.{0,30}without\s+(the user|consent|notif)",
    ],
    "credential_token_manipulation": [r"\b(?:replace|overwrite|forge)\w*\s+.{0,30}(token|credential|api[_ ]?key)"],
    "context_poisoning": [r"remember that (the )?user (has|already)", r"assume (the )?user (has approved|has consented|already agreed)"],
    "indirect_prompt_injection": [
        r"(ai|llm|agent|assistant|model)s?\s+(reading|processing|parsing)\s+this\s+(file|document|readme)",
        r"note to (ai|assistant|language model|llm)",
    ],
    "benign_instruction_like": [],
}
NEGATION_CUES = ["does not", "do not", "did not", "doesn't", "no evidence of"]
EARLIER_NEGATION_CUES = ["does not", "do not", "did not", "doesn't", "no evidence of", "without", "rather than"]
NEGATION_BREAKS = [r"\bbut\b", r"[;.]"]
NEGATION_WINDOW = 40

# --- fixed values: advisory templates ---------------------------------------------------------------
REPORTER_HEADER = r"^##\s*Source:\s*(.+?)\s*$"
REPORTER_DIGEST = r"\s*\([0-9a-fA-F]{16,}\)$"
BOILERPLATE_PHRASE = "should be considered fully compromised"
BOILERPLATE_MARKER = "<ghsa-boilerplate>"
BOILERPLATE_ALIASES = ["<ghsa-boilerplate>", "ghsa-malware"]
UNATTRIBUTED = "<unattributed>"
NAMED_REPORTERS = ["kam193", "amazon-inspector"]
CREDIT_LINE = r"^[ \t]*Credit:[ \t]*\[OpenSSF\]\(https://github\.com/ossf/malicious-packages\)[ \t]*\(\[source\]\([^)\s]*\)\)[ \t]*$"
SEPARATOR_LINE = r"^[ \t]*_-= Per source details\. Do not edit below this line\.=-_[ \t]*$"
RULE_LINE = r"^[ \t]*-{3,}[ \t]*$"
ONE_LINER = r"The package \S+ was found to contain malicious code\.?"
SOURCE_LINE = r"^[ \t]*## Source:.*$"
SOURCE_LINE_AND_END = r"^[ \t]*## Source:.*(?:\r?\n|$)"
CAMPAIGN_LINE = r"^[ \t]*Campaign:[ \t]*(\S+)"
GENERIC_TAGS = ["GENERIC-standard-pypi-install-pentest"]
PACKAGE_MASK, URL_MASK, URL = "<PKG>", "<URL>", r"https?://\S+"
NAME_CHARACTER = r"[A-Za-z0-9_.@/-]"
TAG_HEADER = "Reasons (based on the campaign):"
"""Opens a list of tags inside a text; a horizontal rule ends it."""
# --- end of fixed values ------------------------------------------------------------------------------
