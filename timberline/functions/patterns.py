"""Rule tables of the line operators. Everything here is a fixed value: words, patterns, labels and their order decide results.

Patterns are written in the part of the regex language that Java and RE2 share; (?i) where case does not count."""

# Level words by priority, whole words, case ignored.
LEVEL_PRIORITY = ["FATAL", "CRITICAL", "ERROR", "WARN", "INFO", "DEBUG", "TRACE"]
LEVEL_WORD = {"FATAL": "FATAL", "CRITICAL": "CRITICAL", "ERROR": "ERROR", "WARN": "WARN(?:ING)?", "INFO": "INFO", "DEBUG": "DEBUG", "TRACE": "TRACE"}
LEVEL_RANK = {"UNKNOWN": 0, "TRACE": 1, "DEBUG": 2, "INFO": 3, "WARN": 4, "ERROR": 5, "CRITICAL": 6, "FATAL": 7}
LEVEL_LEFTMOST = "(?i)(DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL|TRACE)"

# Words that make a line an error line.
ERROR_WORDS = [
    "error", "failed", "fatal", "exception", "traceback", "panic", "denied", "timeout", r"not\s+found", r"no\s+such\s+file", r"permission\s+denied",
    r"exit\s+code", r"non-zero\s+code", "assertion", "abort", "critical", r"seg(?:mentation)?\s+fault", r"\boom\b", "killed",
]
STATS_ERROR_WORDS = ["error", "fail", "fatal", "exception", "traceback", "panic", "critical"]
STACK_LINE = r"^\s+(?:at|File|from|\.py)"

# Signatures of build platforms, in order of declaration; a tie falls to the earlier.
PLATFORM_SIGNATURES = {
    "GitHub Actions": [r"##\[error\]", r"##\[group\]", r"##\[warning\]", r"Run\s+actions/", r"Error:\s+Process\s+completed\s+with\s+exit\s+code"],
    "Jenkins": [r"Finished:\s+FAILURE", r"Finished:\s+SUCCESS", r"\[Pipeline\]\s*\}", r"ERROR:\s+Build\s+step", r"Started\s+by\s+user"],
    "Docker": [r"Step\s+", r"--->\s+Running\s+in", r"The\s+command\s+'/bin/sh\s+-c", r"returned\s+a\s+non-zero\s+code", r"ERROR:\s+failed\s+to\s+solve"],
    "npm": [r"npm\s+ERR!", r"npm\s+error", r"npm\s+WARN", r"ERESOLVE\s+could\s+not\s+resolve", r"npm\s+install"],
    "pip": [r"ERROR:\s+Could\s+not\s+find\s+a\s+version", r"ERROR:\s+No\s+matching\s+distribution", r"pip\s+install", r"ResolutionImpossible", r"pip\._internal"],
    "cargo": [r"error\[E0", r"could\s+not\s+compile", r"cargo\s+build", r"aborting\s+due\s+to"],
    "pytest": [r"FAILURES", r"PASSED", r"ERRORS", r"short\s+test\s+summary", r"assert\s+", r"AssertionError"],
    "jest": [r"FAIL\s+", r"Tests:", r"Test\s+Suites:", r"●\s+", r"expect\(received\)"],
    "Gradle": [r"BUILD\s+FAILED", r"BUILD\s+SUCCESSFUL", r">\s*Task\s*:", r"Execution\s+failed\s+for\s+task"],
    "Maven": [r"BUILD\s+FAILURE", r"BUILD\s+SUCCESS", r"\[ERROR\]\s+Failed\s+to\s+execute\s+goal", r"\[INFO\]\s+BUILD\s+FAILURE"],
}

# Labels of error lines, case counts, first match.
ERROR_LABELS = [
    ("ImportError", "ImportError|ModuleNotFoundError"),
    ("SyntaxError", r"SyntaxError|invalid\s+syntax"),
    ("TypeError", "TypeError"),
    ("ValueError", "ValueError"),
    ("KeyError", "KeyError"),
    ("AttributeError", "AttributeError"),
    ("OSError", "OSError|FileNotFoundError|PermissionError"),
    ("HTTPError", r"HTTPError|4\d{2}|5\d{2}"),
    ("TimeoutError", r"TimeoutError|timed?\s*out"),
    ("ConnectionError", r"ConnectionError|Connection\s+refused|ECONNREFUSED"),
    ("OutOfMemory", r"OutOfMemoryError|out\s+of\s+memory|OOM"),
    ("Segfault", r"Segmentation\s+fault|SIGSEGV"),
    ("AssertionError", r"AssertionError|assert\s+failed"),
    ("NullPointer", r"NullPointerException|NoneType.*has\s+no\s+attribute"),
]

# Categories of the deep parse, on the lower-cased line, first match.
DEEP_CATEGORIES = [
    ("ImportError", "importerror|modulenotfounderror"),
    ("SyntaxError", r"syntaxerror|invalid\s+syntax"),
    ("TypeError", "typeerror"),
    ("ValueError", "valueerror"),
    ("KeyError", "keyerror"),
    ("AttributeError", "attributeerror"),
    ("OSError", "oserror|filenotfounderror|permissionerror"),
    ("HTTPError", r"httperror|[45]\d{2}"),
    ("TimeoutError", r"timeouterror|timed?\s*out"),
    ("ConnectionError", r"connectionerror|connection\s+refused|econnrefused"),
    ("OutOfMemory", r"outofmemoryerror|out\s+of\s+memory|oom"),
    ("Segfault", r"segmentation\s+fault|sigsegv"),
    ("AssertionError", r"assertionerror|assert\s+failed"),
    ("NullPointer", r"nullpointerexception|nonetype.*has\s+no\s+attribute"),
    ("BuildError", r"build\s+(?:failed|error|failure)|error\[[a-z]"),
    ("TestFailure", r"tests?\s+(?:failed|run):"),
    ("NetworkError", r"connection\s+(?:refused|reset)|dns\s+(?:resolution|lookup)\s+failed"),
    ("PermissionError", r"permission\s+denied|eacces|eperm"),
    ("UnknownError", "error|failed|fatal"),
    ("Warning", "warn"),
]

# Signs of anomalies, case ignored, and their order as types.
ANOMALY = {
    "burst": r"(?i)\d+\s+(?:errors?|failures?|exceptions?)\s+in\s+\d+\s*(?:ms|s|min)",
    "crash": r"(?i)(?:crash|PANIC|SIG(?:ABRT|SEGV|KILL|TERM)|process\s+(?:exited|killed|terminated|died))",
    "repeated": r"(?i)(?:repeated|recurring?)\s+\d+\s+(?:times|occurrences)",
    "resource": r"(?i)(?:memory|CPU|cpu|disk|storage)\s+(?:usage|utilization)\s+(?:at|exceed|above|over)\s+\d+%",
    "slow": r"(?i)(?:slow|timeout|timed\s*out|took)\s+\d+(?:\.\d+)?\s*(?:ms|s|sec|min)",
    "ratelimit": r"(?i)(?:rate\s+limit|throttl|too\s+many\s+requests)",
}
ANOMALY_ERROR = "(?i)error|fail|fatal|exception"

# Categories of lines, first match.
VERSION_CONFLICT = r"(?i)([\w\-\.]+)\s*@?\s*(\d+\.\d+\.\d+).*?(?:requires|depends|peer).*?([\w\-\.]+)\s*@?\s*(\d+\.\d+\.\d+)"
#: Words without which the pattern cannot match; the pattern alone backtracks over every line.
NEEDS = {VERSION_CONFLICT: "(?i)requires|depends|peer"}
DEPENDENCY_ERROR = r"(?i)(?:Could not find|No matching|Unable to resolve|Failed to download)\s+([\w\-\.\[\]=<>,;\s]+)"
LINE_CATEGORIES = [
    ("version_conflict", VERSION_CONFLICT),
    ("dependency_error", DEPENDENCY_ERROR),
    ("build_error", r"(?i)(?:Build|Compilation|Linking)\s+(?:failed|error|failure)|error[:\[][A-Z]+\d+|undefined\s+reference\s+to"),
    ("test_failure", r"(?i)(?:FAILED|FAILURES|ERRORS)\s*$|Tests?\s+(?:failed|run):\s*\d+|\d+\s+(?:failed|passed|error)\b|assert\s+.*\s*==\s*"),
    ("network_error", r"(?i)Connection\s+(?:refused|reset|timed?\s*out)|DNS\s+(?:resolution|lookup)\s+failed|Network\s+(?:unreachable|error)|ECONNREFUSED|ETIMEDOUT|ENOTFOUND"),
    ("permission_error", r"(?i)Permission\s+denied|EACCES|E?PERM|(?:access|permission)\s+(?:denied|forbidden|restricted)|(?:cannot|unable\s+to)\s+(?:access|open|write|create)"),
    ("unknown_error", "(?i)error"),
    ("warning", "(?i)warn"),
]
FILE_PATH = r"(?:[/\\][\w\-\.]+)+[/\\]?[\w\-\.]+|[\w\-\.]+\.(?:py|js|ts|java|go|rb|rs|cpp|c|h|sh|yaml|yml|json|toml|xml)"
VERSION_NUMBER = r"\d+\.\d+(?:\.\d+)?"
DURATION_SIGN = "took|spent|duration|elapsed|completed|finished"
DURATION = r"(?i)(?:took|spent|duration|elapsed|completed\sin|finished\sin)\s+(?:(\d+)\s*(?:h|hour|hours))?\s*(?:(\d+)\s*(?:m|min|minutes?))?\s*(?:(\d+(?:\.\d+)?)\s*(?:s|sec|seconds?))?"

# Stamps of the line index, in order; the first that parses counts.
STAMP_ISO = r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)"
STAMP_SPACE = r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:[,\.]\d+)?)"
STAMP_SYSLOG = r"([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
STAMP_SECONDS = r"\b(\d{10})(?:\.(\d{1,6}))?\b"
STAMP_MILLIS = r"\b(\d{13})\b"
STAMP_SLASH = r"(\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}(?:[,\.]\d+)?)"
STAMP_US = r"(\d{2}-\d{2}-\d{4}\s+\d{2}:\d{2}:\d{2})"

# Rewrites of the error fingerprint, in order.
FINGERPRINT_REWRITES = [
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?", "{TIMESTAMP}"),
    (r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", "{DATE}"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "{UUID}"),
    (r"0x[0-9a-fA-F]{8,16}\b", "{ADDR}"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b(?::\d+)?", "{IP}"),
    (r"/tmp/\w+", "/tmp/{TMP}"),
    (r"/var/tmp/\w+", "/var/tmp/{TMP}"),
    (r":\d+:\d+", ":{LINE}"),
    (r"(?i)\bline\s+\d+\b", "line {LINE}"),
    (r"(?i)\b(?:pid|tid)\s*[=:]\s*\d+\b", "pid {PID}"),
    (r"(?i)\b(?:build|job)[#-]\d+\b", "{BUILD_ID}"),
    (r"\b\d{4,}\b", "{NUM}"),
    (r"\s+", " "),
]
SKELETON_TOKEN = r"[A-Za-z_][A-Za-z0-9_.]{2,}|Error|Exception|Warning|Fault|ERESOLVE|E[0-9]{4}|(?:denied|refused|timeout|not found|failed|fatal)|(?:permission|segmentation|assertion)"

# Rewrites of the cache fingerprint, in order.
CACHE_REWRITES = [
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?", "<TS>"),
    ("0x[0-9a-fA-F]+", "<HEX>"),
    (r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<UUID>"),
    (r"(?i)\b(?:pid|build)[-=]\d+\b", "<ID>"),
    ("/tmp/[a-zA-Z0-9]+/", "/tmp/<HASH>/"),
    (r"\b\d{4,}\b", "<NUM>"),
    (r"\s+", " "),
]

# Secrets and addresses that the line redactor replaces, in order, and the sign that a line may hold one.
SECRET_RULES = [
    ("jwt", r"\beyJ[a-zA-Z0-9_\-]+\.[a-zA-Z0-9_\-]+\.[a-zA-Z0-9_\-]+", "[JWT]"),
    ("aws_key", r"\bAKIA[0-9A-Z]{16}\b", "[AWS_KEY]"),
    ("aws_secret", r"(?:AWS_SECRET(?:_ACCESS)?_KEY|aws_secret_access_key)[=:]\s*[\"']?([A-Za-z0-9+/]{40})[\"']?", "[AWS_SECRET]"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9_]{36,}\b", "[GITHUB_TOKEN]"),
    ("github_pat", r"\bgithub_pat_[0-9]{2}[A-Za-z0-9_]{22,}\b", "[GITHUB_TOKEN]"),
    ("email", r"[\w.\-+%]+@[\w.\-]+\.[a-zA-Z]{2,}", "[EMAIL]"),
    ("ipv6_full", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", "[IP]"),
    ("ipv4", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", "[IP]"),
    ("credit_card", r"\b(?:4[0-9]{3}|5[1-5][0-9]{2}|3[47][0-9]{2}|6(?:011|5[0-9]{2}))[ -]?(?:[0-9]{4}[ -]?){2}[0-9]{4}\b", "[CC]"),
    ("cn_phone", r"\b1[3-9]\d{9}\b", "[PHONE]"),
    ("cn_id_card", r"\b[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]\b", "[ID_CARD]"),
]
#: Needs a look-behind, which RE2 has not; after ipv6_full in the full chain.
SECRET_IPV6_SHORT = ("ipv6_compressed", r"(?:^|(?<![a-zA-Z0-9:.]))(?:(?:[0-9a-fA-F]{1,4}:){1,7}:|:(?::[0-9a-fA-F]{1,4}){1,7}|(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4})", "[IP]")
SECRET_SIGN = r"@|\beyJ|\bAKIA|AWS_SECRET|aws_secret|github_pat_|\bgh[pousr]_|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|::|:[0-9a-fA-F]{3,4}:|\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}|\d{10,}"

# Text that tries to give orders to a reader, with its severity class.
INJECTIONS = [
    ("system_override_marker", r"(?i)-{3,}\s*SYSTEM\s+OVERRIDE\s*-{3,}"),
    ("ignore_previous_instructions", r"(?i)ignore\s+(all\s+)?(previous|prior|above)\s+(instructions?|directives?|commands?)"),
    ("developer_mode", r"(?i)(you\s+are\s+now\s+in\s+)?developer\s*mode"),
    ("new_system_prompt", r"(?i)new\s+system\s+prompt\s*[:=]"),
    ("output_system_prompt", r"(?i)(output|print|reveal|show|display|tell\s+me)\s+(your\s+|the\s+)?(system\s+(prompt|instructions?|directives?)|instructions?|directives?)"),
    ("override_role", r"(?i)(you\s+are\s+now|from\s+now\s+on\s+you\s+are)\s+(a\s+|an\s+)?(unrestricted|unfiltered|evil|malicious|hacker)"),
    ("jailbreak", r"(?i)\bDAN\b.*\b(do\s+anything\s+now|jailbreak)"),
    ("bypass_content_filter", r"(?i)(bypass|disable|ignore|override)\s+(the\s+)?(content|safety)\s+(filter|restrictions?|guidelines?)"),
    ("xml_cdata_wrap", r"(?is)<!\[CDATA\[.*?\]\]>"),
    ("xml_instruction_override", r"(?i)<\?(?:xml|instruction|system|prompt)[^>]*\?>"),
    ("json_instruction_block", r'(?i)\{\s*"instruction"\s*:\s*"ignore'),
    ("markdown_system_section", r"(?i)#{1,3}\s*(system|instructions?|prompt|role)\s*(:|=)"),
    ("rm_rf_command", r"(?i)\brm\s+-rf\s+/"),
    ("curl_pipe_bash", r"(?i)curl\s+.*\|\s*(bash|sh|zsh)"),
    ("fork_bomb", r"(?i):\(\)\s*\{[^}]*:\|:"),
    ("dd_overwrite", r"(?i)\bdd\s+if=.*\s+of=/dev/"),
    ("env_var_leak", r"(?i)(output|print|display|echo|cat)\s+.*\$?(API_KEY|SECRET|TOKEN|PASSWORD)"),
    ("env_dump", r"(?i)(printenv|env\s*$|set\s*$|export\s*-p)"),
]
TRIPWIRES = ["system override", "ignore all previous", "ignore previous", "ignore prior", "developer mode", "system prompt", "bypass", "unrestricted", "unfiltered", "malicious", "hacker", "do anything now", "jailbreak", "your instructions", "your directives", "system instruction", "system directive", "api_key", "printenv", "rm -rf", "| bash", "|bash", "| sh", "|sh", "cdata["]

# Severity of the patterns above; those not named are low.
INJECTION_SEVERITY = {
    "high": ["system_override_marker", "ignore_previous_instructions", "developer_mode", "new_system_prompt", "output_system_prompt", "override_role", "jailbreak", "bypass_content_filter", "rm_rf_command", "fork_bomb", "dd_overwrite"],
    "medium": ["xml_cdata_wrap", "xml_instruction_override", "json_instruction_block", "markdown_system_section", "env_var_leak", "env_dump", "curl_pipe_bash"],
}

# Commands that must not be run, and those that a person must see first.
COMMANDS_BLOCKED = [
    r"(?i)rm\s+(-[a-zA-Z]*\s+)*--no-preserve-root\s+/",
    r"(?i)rm\s+(-[a-zA-Z]*f[a-zA-Z]*|-[a-zA-Z]*r[a-zA-Z]*f[a-zA-Z]*)\s+/",
    r"(?i)rm\s+-rf\s+/",
    r"(?i)mkfs\.\w+\s+/dev/\w+",
    r"(?i)dd\s+if=/dev/(zero|urandom|random)\s+of=/dev/\w+",
    r"(?i)curl\s+[^|]*\|\s*(ba)?sh",
    r"(?i)wget\s+[^|]*\|\s*(ba)?sh",
    r"(?i)curl\s+[^|]*\|\s*python[23]?",
    r"(?i):\(\)\{.*\}",
    r"(?i)chmod\s+-R\s+777\s+/",
    r"(?i)>\s*/dev/sd[a-z]",
    r"(?i)mv\s+/\s+",
    r"(?i)sudo\s+rm\b",
]
COMMANDS_REVIEWED = [r"(?i)\bsudo\b", r"(?i)docker\s+system\s+prune", r"(?i)kill\s+-9\b", r"(?i)docker\s+rm\s+-f", r"(?i)kubectl\s+delete\b", r"(?i)git\s+push\s+--force"]

# Fixed values: (pattern, level, category) of commands; the first that is found counts.
COMMAND_CLASSES = [
    (r"(?i)rm\s+(-[a-zA-Z]*\s+)*--no-preserve-root\s+/", "dangerous", "destructive"),
    (r"(?i)rm\s+(-[a-zA-Z]*f[a-zA-Z]*|-[a-zA-Z]*r[a-zA-Z]*f[a-zA-Z]*)\s+/", "dangerous", "destructive"),
    (r"(?i)rm\s+-rf\s+/", "dangerous", "destructive"),
    (r"(?i)mkfs\.\w+\s+/dev/\w+", "dangerous", "destructive"),
    (r"(?i)dd\s+if=/dev/(zero|urandom|random)\s+of=/dev/\w+", "dangerous", "destructive"),
    (r"(?i):\(\)\{.*\}", "dangerous", "destructive"),
    (r"(?i)>\s*/dev/sd[a-z]", "dangerous", "destructive"),
    (r"(?i)mv\s+/\s+", "dangerous", "destructive"),
    (r"(?i)rm\s+-rf\s+/\*", "dangerous", "destructive"),
    (r"(?i)curl\s+[^\|]*\|\s*(ba)?sh", "dangerous", "supply_chain"),
    (r"(?i)wget\s+[^\|]*\|\s*(ba)?sh", "dangerous", "supply_chain"),
    (r"(?i)chmod\s+-R\s+777\s+/", "dangerous", "privilege_escalation"),
    (r"(?i)nc\s+.*-e\s+/bin/", "dangerous", "data_exfiltration"),
    (r"(?i)cat\s+/etc/(shadow|passwd)", "review", "data_exfiltration"),
    (r"(?i)curl\s+.*\s+--data.*(/etc/|/root/|/home/)", "review", "data_exfiltration"),
]
COMMAND_SUDO = r"(?i)^sudo\s+"
COMMAND_SYSTEM_WRITE = r"(?i)(tee|cp|mv|chmod|chown|mkdir|touch|rm)\s+[^|;]*\s+(/etc/|/usr/|/bin/|/sbin/)"

# Marks of text left out, and stamps of the timeline, leftmost first.
OMITTED_TEXT = "\n\n... [日志过长，中间部分已省略] ...\n\n"
OMITTED_LINES = ("\n\n... [省略了 ", " 行] ...\n\n")
TIMELINE_STAMP = r"(?i)(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?|\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}|\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}|\b1[3-9]\d{8}\d{1,3}\b)"
