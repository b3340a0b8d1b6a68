"""Fixed values of the data model: languages, file extensions, categories, and the words of the rule-based classifier.

Names of products and of their tools are the caller's: dimension tables and prefix lists are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

# Canonical languages and their file extensions.
EXTENSION = {
    "bash": ".sh", "c": ".c", "cpp": ".cpp", "csharp": ".cs", "go": ".go", "java": ".java", "javascript": ".js", "json": ".json", "kotlin": ".kt", "php": ".php", "python": ".py",
    "ruby": ".rb", "rust": ".rs", "scala": ".scala", "shell": ".sh", "swift": ".swift", "text": ".txt", "typescript": ".ts", "undefined": ".txt", "xml": ".xml", "yaml": ".yaml",
}
LANGUAGES = list(EXTENSION)
# Other spellings of a language in a catalogue; case counts.
CATALOGUE_ALIASES = {
    "": "undefined", "console": "shell", "cs": "csharp", "golang": "go", "http": "text", "ini": "text", "js": "javascript", "none": "undefined", "sh": "shell",
    "json\\n :copyable: false": "json", "json\\n :copyable: true": "json",
}
# Spellings in source trees, compared in lower case; an unknown one stands for itself.
TREE_ALIASES = {
    "c++": "cpp", "c#": "csharp", "cs": "csharp", "golang": "go", "js": "javascript", "kt": "kotlin", "py": "python", "rb": "ruby", "rs": "rust", "sh": "shell",
    "ts": "typescript", "txt": "text", "ps1": "powershell", "": "undefined", "none": "undefined",
}
TREE_EXTENSION = {k: v for k, v in EXTENSION.items() if k not in ("json", "xml", "yaml")} | {"console": ".sh", "powershell": ".ps1", "ps5": ".ps1"}

SYNTAX, USAGE, RETURN_OBJECT, CONFIGURATION, OTHER_COMMAND = CATEGORIES = ("Syntax example", "Usage example", "Example return object", "Example configuration object", "Other command")
UNCATEGORIZED = "Uncategorized"
#: Buckets of languages that share rules; a language of none has the bucket "".
BUCKETS = {
    "shell": ("bash", "shell"),
    "json-like": ("json", "xml", "yaml"),
    "drivers-minus-js": ("c", "cpp", "csharp", "go", "java", "kotlin", "php", "python", "ruby", "rust", "scala", "swift", "typescript"),
    "javascript": ("javascript",),
    "text": ("text",),
    "undefined": ("undefined",),
}
#: File name extension to language; .sh counts as shell.
LANGUAGE_OF_EXTENSION = {v: k for k, v in EXTENSION.items() if k not in ("bash", "undefined")}


@dataclass(frozen=True)
class RuleWords:
    """Words that the rules look for. Add the names of your own command-line tools and connection schemes."""

    syntax_prefixes: tuple[str, ...] = ()
    # How usage examples and commands of other tools begin.
    usage_prefixes: tuple[str, ...] = ("import ", "from ", "namespace ", "package ", "using ", "curl ")
    command_prefixes: tuple[str, ...] = ("mkdir ", "cd ", "touch ", "docker ", "docker-compose ", "brew ", "yum ", "apt-", "npm ", "pip ", "go run ", "node ", "dotnet ", "export ", "sudo ", "cp ", "tar ", "jq ", "vi ", "cmake ", "syft ", "choco ")
    # What is looked for in the first bytes.
    usage_strings: tuple[str, ...] = (".aggregate",)
    return_strings: tuple[str, ...] = ("warning", "deprecated", "_id")
    command_strings: tuple[str, ...] = ("cmake ",)
    head_bytes: int = 50
    stage_pattern: str = r"(?s)\$[a-zA-Z]{2,}: ?(.*?<.+?>)?"
