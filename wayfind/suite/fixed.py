"""Names that the SQL of the queries goes by, written out apart from the engine's own lists.

Fixed values, from the specification of paths and landmarks: a wrong list in the engine shows as
a difference between a query and its SQL.
"""

GENERATED = "target dist build _build out coverage generated gen obj bin .gradle .next .nuxt .svelte-kit .astro .turbo .vite .dart_tool tmp".split()
VENDOR = "vendor node_modules .pnpm-store .venv venv bower_components third_party third-party external deps vendor_modules pods".split()
GENERATED_STEMS = "generated autogenerated auto-generated codegen generated_code".split()
GENERATED_ENDINGS = ".generated .gen _pb .designer".split()
EXTENSIONS = {
    "rust": "rs", "javascript": "js mjs cjs", "javascript_jsx": "jsx", "typescript": "ts mts cts", "typescript_tsx": "tsx", "python": "py pyi", "ruby": "rb rake gemspec", "java": "java",
    "c_sharp": "cs", "go": "go", "lua": "lua rockspec",
}
READMES = "readme readme.md readme.rst readme.txt".split()
CONTRIBUTORS = "code_of_conduct.md community.md".split()
AGENTS = "agents.md claude.md codex.md".split()
MANIFESTS = """cargo.toml package.json pyproject.toml setup.py setup.cfg gemfile gemspec pom.xml build.gradle build.gradle.kts settings.gradle settings.gradle.kts composer.json mix.exs
 pnpm-workspace.yaml pnpm-workspace.yml lerna.json nx.json go.mod go.work""".split()
LOCKFILES = "cargo.lock package-lock.json pnpm-lock.yaml yarn.lock bun.lockb poetry.lock uv.lock gemfile.lock go.sum composer.lock".split()
BUILDS = "build.rs makefile gnumakefile pom.xml build.gradle build.gradle.kts".split()
TASKS = "justfile taskfile.yml taskfile.yaml rakefile procfile".split()
CI = ".gitlab-ci.yml .gitlab-ci.yaml azure-pipelines.yml azure-pipelines.yaml".split()
OWNERS = "codeowners owners maintainers".split()
LICENSES = "license copying notice".split()
