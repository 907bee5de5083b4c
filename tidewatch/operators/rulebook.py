"""The built-in line rules: ids, severities, categories, capabilities and patterns are fixed values; the titles are ours."""

from __future__ import annotations

from dataclasses import dataclass

SEVERITIES = ("info", "low", "medium", "high", "critical")
# Capabilities in the order of output.
CAPABILITIES = (
    "filesystem_read", "filesystem_write", "file_delete", "code_execution", "shell_execution", "network_access",
    "environment_read", "git_operations", "privilege_escalation", "persistence", "download_execute", "sensitive_data_access",
)


@dataclass(frozen=True)
class Rule:
    id: str
    language: str
    severity: str
    category: str
    capabilities: tuple[str, ...]
    title: str
    pattern: str


# Fixed values, in rule order per language.
BUILTIN = (
    Rule("SI-SH-001", "shell", "high", "download_and_execute", ("network_access", "download_execute", "shell_execution"), "Fetched script goes straight into a shell", r"\b(?:curl|wget)\b[^|#\n]*\|\s*(?:bash|sh)\b"),
    Rule("SI-SH-002", "shell", "critical", "obfuscated_execution", ("code_execution", "shell_execution"), "Decoded text goes straight into a shell", r"\bbase64\b[^|#\n]*(?:-d|--decode)[^|#\n]*\|\s*(?:bash|sh)\b"),
    Rule("SI-SH-003", "shell", "high", "destructive_file_operation", ("file_delete",), "Forced deletion of a tree", r"\brm\s+(?:-[^\s]*r[^\s]*f|-[^\s]*f[^\s]*r)\b"),
    Rule("SI-SH-004", "shell", "medium", "permission_change", ("filesystem_write",), "Changed owner or mode", r"\b(?:chmod|chown)\b"),
    Rule("SI-SH-005", "shell", "high", "privilege_escalation", ("privilege_escalation",), "Command with raised rights", r"\bsudo\b"),
    Rule("SI-SH-006", "shell", "low", "network_access", ("network_access",), "Download tool", r"\b(?:curl|wget)\b"),
    Rule("SI-SH-007", "shell", "medium", "remote_access", ("network_access",), "Login or copy to another host", r"\b(?:ssh|scp)\b"),
    Rule("SI-SH-008", "shell", "medium", "system_configuration", (), "Service or timetable tool", r"\b(?:systemctl|crontab)\b"),
    Rule("SI-SH-009", "shell", "high", "persistence", ("persistence",), "Service or timetable made permanent", r"\bsystemctl\s+(?:enable|reenable)\b|\bcrontab\s+(?:-[er]\b|[^-\s#][^\s#]*)"),
    Rule("SI-SH-010", "shell", "low", "git_operation", ("git_operations",), "Git command", r"\bgit\s+(?:clone|fetch|pull|push|checkout|switch|reset|clean|submodule|worktree|commit|tag|branch)\b"),
    Rule("SI-BAT-001", "batch", "medium", "command_execution", ("shell_execution",), "Interpreter started inside a script", r"(?i)\bcmd(?:\.exe)?\s+/[ck]\b"),
    Rule("SI-BAT-002", "batch", "medium", "remote_download", ("network_access",), "Download tool in a batch file", r"(?i)\b(?:curl|certutil|bitsadmin)\b"),
    Rule("SI-BAT-003", "batch", "high", "destructive_file_operation", ("file_delete",), "Forced deletion of a folder tree", r"(?i)\b(?:rmdir|rd)\s+(?=[^\r\n]*\/s\b)(?=[^\r\n]*\/q\b)|\bdel\s+(?=[^\r\n]*\/s\b)(?=[^\r\n]*\/q\b)"),
    Rule("SI-BAT-004", "batch", "high", "persistence", ("persistence", "filesystem_write"), "Task or start entry that persists", r"(?i)\bschtasks\b[^\r\n]*\/(?:create|change)\b|\breg\s+add\b[^\r\n]*(?:\\Run|\\RunOnce)\b"),
    Rule("SI-BAT-005", "batch", "critical", "obfuscated_execution", ("code_execution", "shell_execution"), "Encoded command for another shell", r"(?i)\bpowershell(?:\.exe)?\b[^\r\n]*-(?:EncodedCommand|enc)\b"),
    Rule("SI-PS-001", "powershell", "high", "dynamic_code_execution", ("code_execution", "shell_execution"), "Text run as an expression", r"(?i)\b(?:Invoke-Expression|IEX)\b"),
    Rule("SI-PS-002", "powershell", "low", "network_access", ("network_access",), "Web request", r"(?i)\b(?:Invoke-WebRequest|iwr)\b"),
    Rule("SI-PS-003", "powershell", "medium", "command_execution", ("shell_execution",), "Started process", r"(?i)\bStart-Process\b"),
    Rule("SI-PS-004", "powershell", "medium", "remote_download", ("network_access",), "Remote text fetched", r"(?i)\bDownloadString\s*\("),
    Rule("SI-PS-005", "powershell", "critical", "obfuscated_execution", ("code_execution", "shell_execution"), "Encoded command", r"(?i)-(?:EncodedCommand|enc)\b"),
    Rule("SI-PS-006", "powershell", "medium", "hidden_execution", ("shell_execution",), "Hidden window", r"(?i)-WindowStyle\s+Hidden\b"),
    Rule("SI-PS-007", "powershell", "high", "security_bypass", ("shell_execution",), "Execution policy switched off", r"(?i)-ExecutionPolicy\s+(?:Bypass|Unrestricted)\b"),
    Rule("SI-PRM-001", "prompt", "medium", "prompt_injection", (), "Text that cancels earlier instructions", r"(?i)\bignore\s+(?:all\s+)?(?:previous|prior|system|developer)\s+instructions?\b"),
    Rule("SI-PRM-002", "prompt", "medium", "prompt_injection", (), "Text that asks for hidden instructions", r"(?i)\b(?:reveal|show|print|return|expose)\b[^\n]{0,80}\bsystem\s+prompt\b"),
    Rule("SI-PRM-003", "prompt", "high", "prompt_injection", ("environment_read", "network_access", "sensitive_data_access"), "Text that has secrets collected and sent", r"(?i)\b(?:read|access|collect)\b[^\n]{0,80}\benvironment\s+variables?\b[^\n]{0,120}\b(?:send|upload|post|exfiltrate)\b[^\n]{0,80}\bsecrets?\b"),
    Rule("SI-PRM-004", "prompt", "high", "prompt_injection", (), "Text that switches safety rules off", r"(?i)\b(?:ignore|disable|bypass|override)\b[^\n]{0,80}\b(?:security|safety)\s+(?:rules?|checks?|policy|policies)\b"),
)
# Secret kinds of our own over the credential shapes that redaction knows; only the first two ids have known counterparts.
SECRETS = (
    ("SI-SEC-001", "high", "Secret assigned in the text", "assignment"),
    ("SI-SEC-002", "high", "Service key in the text", "api_key"),
    ("SI-SEC-003", "high", "Repository token in the text", "git_token"),
    ("SI-SEC-004", "critical", "Private key in the text", "private_key"),
    ("SI-SEC-005", "high", "Cloud key id in the text", "cloud_key"),
    ("SI-SEC-006", "high", "Bearer token in the text", "bearer"),
    ("SI-SEC-007", "medium", "Login in an address", "url_login"),
)
_ROOT = r"(?:~[\\/]|\$HOME[\\/]|\$\{HOME\}[\\/]|%USERPROFILE%[\\/])?"
# Path classes in the order in which the first wins.
SENSITIVE_PATHS = (
    ("ssh", "medium", rf"(?i)(?<![\w]){_ROOT}\.ssh(?:[\\/]|(?![\w]))"),
    ("aws", "medium", rf"(?i)(?<![\w]){_ROOT}\.aws(?:[\\/]|(?![\w]))"),
    ("browser", "medium", r"(?i)(?:Google[\\/]Chrome[\\/]User Data|Mozilla[\\/]Firefox|Firefox[\\/]Profiles|Library[\\/]Application Support[\\/]Google[\\/]Chrome)"),
    ("system", "medium", r"""(?i)(?:^|[\s'"(])(?:/etc/|(?:[A-Z]:)?[\\/]Windows[\\/]System32[\\/])"""),
    ("environment_file", "medium", r"(?i)(?<![\w])\.env(?:\.[A-Za-z0-9_.-]+)?(?![\w])"),
    ("user_config", "low", rf"(?i)(?<![\w]){_ROOT}\.config(?:[\\/]|(?![\w]))"),
    ("home", "low", r"(?i)(?:~[\\/]|\$HOME(?:[\\/]|\b)|\$\{HOME\}[\\/]|%USERPROFILE%[\\/])"),
)
