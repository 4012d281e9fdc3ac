"""Fixed values of the two profiles, as their results depend on them."""

# Query words that profile B leaves out.
STOPWORDS = """
a an and are as at be by for from has have he in is it its of on or that the to was were will with this which how what
when where who why can could would should may might must do does did done explain describe show tell find get called
function class file code
""".split()

# Endings and what replaces them, first that fits and leaves three letters (profile B).
STEM_RULES = [
    ("tion", "t"),
    ("sion", "s"),
    ("ies", "y"),
    ("ied", "y"),
    ("ation", ""),
    ("ement", ""),
    ("ment", ""),
    ("ing", ""),
    ("ed", ""),
    ("es", ""),
    ("er", ""),
    ("ly", ""),
    ("e", ""),
    ("s", ""),
]

# Languages by suffix, profile P (others: none).
LANGUAGES_P = {
    "py": "python", "js": "javascript", "ts": "typescript", "jsx": "jsx", "tsx": "tsx", "vue": "vue",
    "svelte": "svelte", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "java": "java", "kt": "kotlin",
    "scala": "scala", "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp", "cs": "csharp", "fs": "fsharp",
    "swift": "swift", "m": "objc", "sh": "bash", "bash": "bash", "zsh": "zsh", "sql": "sql", "graphql": "graphql",
    "html": "html", "css": "css", "scss": "scss", "less": "less", "json": "json", "yaml": "yaml", "yml": "yaml",
    "toml": "toml", "md": "markdown", "mdx": "mdx", "rst": "rst", "dockerfile": "dockerfile", "tf": "terraform",
}

# Languages by what follows the last dot, profile B (others: text).
LANGUAGES_B = {
    "js": "javascript", "jsx": "jsx", "ts": "typescript", "tsx": "tsx", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyw": "python", "pyi": "python", "go": "go", "rs": "rust", "rb": "ruby", "rake": "ruby",
    "php": "php", "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "c": "c", "h": "c", "cpp": "cpp",
    "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "cs": "csharp", "fs": "fsharp", "swift": "swift", "m": "objc",
    "mm": "objc", "sh": "bash", "bash": "bash", "zsh": "zsh", "json": "json", "yaml": "yaml", "yml": "yaml",
    "toml": "toml", "xml": "xml", "md": "markdown", "mdx": "mdx", "rst": "rst", "html": "html", "htm": "html",
    "css": "css", "scss": "scss", "less": "less", "sql": "sql", "graphql": "graphql", "gql": "graphql",
    "dockerfile": "dockerfile", "tf": "terraform", "vue": "vue", "svelte": "svelte",
}

# Names that profile P leaves out.
IGNORE_DIRS = """
.git .svn .hg node_modules __pycache__ .venv venv env .env dist build .next .nuxt target out .idea .vscode .cache
coverage .pytest_cache .mypy_cache
""".split()
IGNORE_FILES = """
.DS_Store Thumbs.db .gitignore .gitattributes package-lock.json yarn.lock pnpm-lock.yaml Cargo.lock poetry.lock
uv.lock CHANGELOG.md CHANGELOG HISTORY.md CONTRIBUTING.md LICENSE LICENSE.md NOTICE
""".split()

# Suffixes of files that are not text.
BINARY_P = """
png jpg jpeg gif ico webp svg bmp pdf zip tar gz rar 7z exe dll so dylib bin mp3 mp4 wav avi mov woff woff2 ttf eot
pyc pyo class o
""".split()
BINARY_B = """
png jpg jpeg gif bmp ico webp svg mp3 mp4 wav avi mov pdf zip tar gz rar 7z exe dll so dylib woff woff2 ttf eot otf
pyc pyo class o a lib
""".split()

# Patterns that profile B ignores, in the manner of a .gitignore.
EXCLUDES_B = """
.git .git/** node_modules node_modules/** __pycache__ __pycache__/** .venv .venv/** venv venv/** .env dist dist/**
build build/** .next .next/** .nuxt .nuxt/** .output .output/** coverage coverage/** .pytest_cache .pytest_cache/**
.mypy_cache .mypy_cache/** .ruff_cache .ruff_cache/** target target/** vendor vendor/** .idea .idea/** .vscode
.vscode/** *.min.js *.min.css *.map *.lock package-lock.json yarn.lock pnpm-lock.yaml bun.lockb
""".split()

# Limits of a file, of a chunk in lines.
MAX_BYTES, MAX_FILE_LINES, MAX_LINES, MIN_LINES = 1_048_576, 20_000, 200, 10

# Importance lists, profile P (names without case).
ENTRY_P = """
main.py app.py index.py server.py cli.py main.ts app.ts index.ts server.ts main.js app.js index.js server.js main.go
main.rs lib.rs readme.md readme.rst setup.py pyproject.toml package.json cargo.toml go.mod
""".split()
HIGH_DIRS_P = """
src lib core api app server
""".split()
LOW_DIRS_P = """
test tests spec specs __tests__ examples example samples sample docs doc documentation scripts tools utils helpers
vendor third_party migrations fixtures
""".split()

# Importance lists, profile B.
ENTRY_B = """
index.ts index.js index.tsx index.jsx main.ts main.js main.py mod.rs lib.rs main.rs main.go app.ts app.js app.py
server.ts server.js cli.ts cli.js cli.py __init__.py setup.py package.json Cargo.toml go.mod
""".split()
HIGH_DIRS_B = """
src lib core api routes controllers services models components hooks utils helpers
""".split()
LOW_DIRS_B = """
test tests __tests__ spec specs e2e fixtures mocks stubs examples docs scripts tools config configs
""".split()
LOW_NAMES_B = [r"\.test\.", r"\.spec\.", r"_test\.", r"_spec\.", r"\.d\.ts$", r"\.config\.", r"\.mock\."]

# Definition patterns of profile P (language: pattern on the stripped line, type, group of the name).
DEFINITIONS_P = {
    "python": [
        (r"^(async\s+)?def\s+(\w+)", "function", 2),
        (r"^class\s+(\w+)", "class", 1),
    ],
    "javascript": [
        (r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)", "function", 1),
        (r"^(?:export\s+)?class\s+(\w+)", "class", 1),
        (r"^(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\(", "function", 1),
    ],
    "go": [
        (r"^func\s+(?:\([^)]+\)\s+)?(\w+)", "function", 1),
        (r"^type\s+(\w+)\s+struct", "struct", 1),
        (r"^type\s+(\w+)\s+interface", "interface", 1),
    ],
    "rust": [
        (r"^(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", "function", 1),
        (r"^(?:pub\s+)?mod\s+(\w+)", "module", 1),
        (r"^(?:pub\s+)?struct\s+(\w+)", "struct", 1),
        (r"^(?:pub\s+)?enum\s+(\w+)", "enum", 1),
        (r"^(?:pub\s+)?trait\s+(\w+)", "trait", 1),
        (r"^impl(?:<[^>]+>)?\s+(\w+)", "impl", 1),
    ],
    "java": [
        (r"^(?:public\s+|protected\s+|private\s+)?(?:static\s+|final\s+|abstract\s+)*class\s+(\w+)", "class", 1),
        (r"^(?:public\s+|protected\s+|private\s+)?(?:static\s+|final\s+)*interface\s+(\w+)", "interface", 1),
        (r"^(?:public\s+|protected\s+|private\s+)?enum\s+(\w+)", "enum", 1),
    ],
    "typescript": [
        (r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)", "function", 1),
        (r"^(?:export\s+)?class\s+(\w+)", "class", 1),
        (r"^(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\(", "function", 1),
        (r"^(?:export\s+)?interface\s+(\w+)", "interface", 1),
        (r"^(?:export\s+)?type\s+(\w+)", "type", 1),
    ],
}

# Definition patterns of profile B (on the whole line; the name is group 1).
DEFINITIONS_B = {
    "python": [
        (r"^(?:async\s+)?def\s+(\w+)", "function"),
        (r"^class\s+(\w+)", "class"),
    ],
    "javascript": [
        (r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)", "function"),
        (r"^(?:export\s+)?class\s+(\w+)", "class"),
        (r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=", "constant"),
    ],
    "typescript": [
        (r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)", "function"),
        (r"^(?:export\s+)?class\s+(\w+)", "class"),
        (r"^(?:export\s+)?interface\s+(\w+)", "interface"),
        (r"^(?:export\s+)?type\s+(\w+)\s*=", "type"),
        (r"^(?:export\s+)?enum\s+(\w+)", "enum"),
        (r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*[=:]", "constant"),
    ],
    "tsx": [
        (r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)", "function"),
        (r"^(?:export\s+)?class\s+(\w+)", "class"),
        (r"^(?:export\s+)?interface\s+(\w+)", "interface"),
        (r"^(?:export\s+)?type\s+(\w+)\s*=", "type"),
        (r"^(?:export\s+)?(?:const|let)\s+(\w+)\s*[=:]", "constant"),
    ],
    "go": [
        (r"^func\s+(?:\([^)]+\)\s+)?(\w+)", "function"),
        (r"^type\s+(\w+)\s+struct", "class"),
        (r"^type\s+(\w+)\s+interface", "interface"),
    ],
    "rust": [
        (r"^(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", "function"),
        (r"^(?:pub\s+)?struct\s+(\w+)", "class"),
        (r"^(?:pub\s+)?enum\s+(\w+)", "enum"),
        (r"^(?:pub\s+)?trait\s+(\w+)", "interface"),
        (r"^impl(?:<[^>]+>)?\s+(\w+)", "class"),
        (r"^(?:pub\s+)?mod\s+(\w+)", "module"),
    ],
    "ruby": [
        (r"^def\s+(\w+)", "function"),
        (r"^class\s+(\w+)", "class"),
        (r"^module\s+(\w+)", "module"),
    ],
    "php": [
        (r"^(?:public|private|protected)?\s*function\s+(\w+)", "function"),
        (r"^class\s+(\w+)", "class"),
        (r"^interface\s+(\w+)", "interface"),
        (r"^trait\s+(\w+)", "class"),
    ],
    "java": [
        (r"^(?:public|private|protected)?\s*(?:static\s+)?(?:\w+\s+)+(\w+)\s*\(", "function"),
        (r"^(?:public|private|protected)?\s*class\s+(\w+)", "class"),
        (r"^(?:public|private|protected)?\s*interface\s+(\w+)", "interface"),
        (r"^(?:public|private|protected)?\s*enum\s+(\w+)", "enum"),
    ],
    "kotlin": [
        (r"^(?:suspend\s+)?fun\s+(\w+)", "function"),
        (r"^(?:data\s+)?class\s+(\w+)", "class"),
        (r"^interface\s+(\w+)", "interface"),
        (r"^object\s+(\w+)", "class"),
        (r"^enum\s+class\s+(\w+)", "enum"),
    ],
    "scala": [
        (r"^def\s+(\w+)", "function"),
        (r"^class\s+(\w+)", "class"),
        (r"^trait\s+(\w+)", "interface"),
        (r"^object\s+(\w+)", "class"),
        (r"^case\s+class\s+(\w+)", "class"),
    ],
    "swift": [
        (r"^func\s+(\w+)", "function"),
        (r"^class\s+(\w+)", "class"),
        (r"^struct\s+(\w+)", "class"),
        (r"^protocol\s+(\w+)", "interface"),
        (r"^enum\s+(\w+)", "enum"),
        (r"^extension\s+(\w+)", "class"),
    ],
    "csharp": [
        (r"^(?:public|private|protected|internal)?\s*(?:static\s+)?(?:async\s+)?(?:\w+\s+)+(\w+)\s*\(", "function"),
        (r"^(?:public|private|protected|internal)?\s*class\s+(\w+)", "class"),
        (r"^(?:public|private|protected|internal)?\s*interface\s+(\w+)", "interface"),
        (r"^(?:public|private|protected|internal)?\s*struct\s+(\w+)", "class"),
        (r"^(?:public|private|protected|internal)?\s*enum\s+(\w+)", "enum"),
    ],
    "c": [
        (r"^(?:static\s+)?(?:\w+\s+)+(\w+)\s*\([^)]*\)\s*\{", "function"),
        (r"^struct\s+(\w+)", "class"),
        (r"^typedef\s+struct\s+(\w+)", "class"),
        (r"^enum\s+(\w+)", "enum"),
    ],
    "cpp": [
        (r"^(?:virtual\s+)?(?:\w+\s+)+(\w+)\s*\([^)]*\)\s*(?:const\s*)?\{", "function"),
        (r"^class\s+(\w+)", "class"),
        (r"^struct\s+(\w+)", "class"),
        (r"^namespace\s+(\w+)", "module"),
        (r"^enum\s+(?:class\s+)?(\w+)", "enum"),
    ],
    "jsx": [
        (r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)", "function"),
        (r"^(?:export\s+)?class\s+(\w+)", "class"),
        (r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=", "constant"),
    ],
    "mjs": [
        (r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)", "function"),
        (r"^(?:export\s+)?class\s+(\w+)", "class"),
        (r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=", "constant"),
    ],
    "cjs": [
        (r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)", "function"),
        (r"^(?:export\s+)?class\s+(\w+)", "class"),
        (r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=", "constant"),
    ],
    "objc": [
        (r"^(?:static\s+)?(?:\w+\s+)+(\w+)\s*\([^)]*\)\s*\{", "function"),
        (r"^struct\s+(\w+)", "class"),
        (r"^typedef\s+struct\s+(\w+)", "class"),
        (r"^enum\s+(\w+)", "enum"),
    ],
}

# Import patterns of profile P (at the start of the stripped line; the module's group, and the dots' if any).
IMPORTS_P = {
    "python": [
        (r"^from\s+(\.+)?(\S+)\s+import", 2, 1),
        (r"^import\s+(\S+)", 1, 0),
    ],
    "javascript": [
        (r"""^import\s+.*?\s+from\s+['\"](.+?)['\"]""", 1, 0),
        (r"""^import\s+['\"](.+?)['\"]""", 1, 0),
        (r"""^require\(['\"](.+?)['\"]\)""", 1, 0),
    ],
    "typescript": [
        (r"""^import\s+.*?\s+from\s+['\"](.+?)['\"]""", 1, 0),
        (r"""^import\s+['\"](.+?)['\"]""", 1, 0),
        (r"""^require\(['\"](.+?)['\"]\)""", 1, 0),
    ],
    "go": [
        (r'^\s*\"(.+?)\"', 1, 0),
        (r'^import\s+\"(.+?)\"', 1, 0),
    ],
    "rust": [
        (r"^use\s+(\S+)", 1, 0),
        (r"^mod\s+(\w+)", 1, 0),
    ],
}

# Import patterns of profile B (every match in the file counts).
IMPORTS_B = {
    "python": [
        r"^from\s+([\w.]+)\s+import",
        r"^import\s+([\w.]+)",
    ],
    "javascript": [
        r"""import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]""",
        r"""require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)""",
        r"""import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)""",
    ],
    "typescript": [
        r"""import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]""",
        r"""require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)""",
        r"""import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)""",
    ],
    "tsx": [
        r"""import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]""",
        r"""require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)""",
        r"""import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)""",
    ],
    "jsx": [
        r"""import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]""",
        r"""require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)""",
        r"""import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)""",
    ],
    "mjs": [
        r"""import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]""",
        r"""require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)""",
        r"""import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)""",
    ],
    "cjs": [
        r"""import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]""",
        r"""require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)""",
        r"""import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)""",
    ],
    "go": [
        r"""import\s+[\"']([^\"']+)[\"']""",
        r"""import\s+\([^)]*[\"']([^\"']+)[\"']""",
    ],
    "rust": [
        r"use\s+([\w:]+)",
        r"mod\s+(\w+)",
    ],
    "ruby": [
        r"""require\s+['\"]([^'\"]+)['\"]""",
        r"""require_relative\s+['\"]([^'\"]+)['\"]""",
    ],
}

# What a module's name may end in, in the order tried, profile P.
RESOLVE_P = {
    "python": [".py", "/__init__.py"],
    "javascript": [".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js"],
    "typescript": [".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js"],
}

# What a module's name may end in, in the order tried, profile B.
RESOLVE_B = {
    "typescript": [".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx"],
    "javascript": [".js", ".jsx", ".ts", ".tsx", "/index.js", "/index.jsx"],
    "python": [".py", "/__init__.py"],
    "tsx": [".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx"],
    "jsx": [".js", ".jsx", ".ts", ".tsx", "/index.js", "/index.jsx"],
}
