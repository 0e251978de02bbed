"""Which files of a repository are indexed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in natural order: patterns of files that are indexed, patterns that leave files out, and the largest size in bytes.
INCLUDED = """
**/*.ts **/*.tsx **/*.js **/*.jsx **/*.mjs **/*.cjs
**/*.py **/*.pyi
**/*.rs **/*.go **/*.c **/*.cpp **/*.h **/*.hpp
**/*.java **/*.kt **/*.scala
**/*.cs **/*.fs
**/*.rb **/*.php **/*.swift
**/*.sh **/*.bash
**/*.md **/*.json **/*.yaml **/*.yml **/*.toml
**/tsconfig.json **/tsconfig.*.json **/jsconfig.json
**/eslint.config.js **/eslint.config.mjs **/eslint.config.cjs **/eslint.config.ts
**/.eslintrc **/.eslintrc.js **/.eslintrc.cjs **/.eslintrc.json **/.eslintrc.yml **/.eslintrc.yaml
**/.prettierrc **/.prettierrc.json **/.prettierrc.yml **/.prettierrc.yaml **/.prettierrc.js **/.prettierrc.cjs **/.prettierrc.mjs
**/prettier.config.js **/prettier.config.cjs **/prettier.config.mjs
**/package.json **/composer.json
**/pyproject.toml **/setup.py **/setup.cfg **/requirements.txt **/Pipfile **/tox.ini **/.python-version
**/go.mod
**/Cargo.toml
**/.editorconfig
**/Dockerfile **/dockerfile **/docker-compose.yml **/docker-compose.yaml **/compose.yml **/compose.yaml
**/.gitlab-ci.yml **/.travis.yml **/azure-pipelines.yml **/.github/workflows/*.yml **/.github/workflows/*.yaml **/.circleci/config.yml **/Jenkinsfile
**/babel.config.js **/babel.config.json **/.babelrc **/webpack.config.js **/webpack.config.ts **/vite.config.js **/vite.config.ts **/rollup.config.js **/rollup.config.ts
**/jest.config.js **/jest.config.ts **/vitest.config.ts **/vitest.config.js **/pytest.ini
**/.npmrc **/.yarnrc **/.nvmrc **/.env.example **/.env.template
""".split()
EXCLUDED = """
**/node_modules/** **/vendor/** **/venv/** **/.venv/** **/env/** **/.env/** **/packages/**/node_modules/**
**/dist/** **/build/** **/out/** **/target/** **/.next/** **/.nuxt/** **/coverage/** **/.nyc_output/**
**/.git/** **/.svn/** **/.hg/**
**/.idea/** **/.vscode/** **/.vs/**
**/__pycache__/** **/.pytest_cache/** **/.mypy_cache/** **/.ruff_cache/** **/.cache/**
**/__snapshots__/** **/fixtures/**
**/package-lock.json **/yarn.lock **/pnpm-lock.yaml **/bun.lockb **/Cargo.lock **/poetry.lock **/Pipfile.lock **/composer.lock **/Gemfile.lock
**/*.min.js **/*.min.css **/*.bundle.js **/*.map
""".split()
MOST_BYTES = 10_000_000


def indexed(path: Column, size: Column | None = None, included: list[str] = INCLUDED, excluded: list[str] = EXCLUDED) -> Column:
    """Whether a file is indexed, by its path and, if given, its size."""
    from textquarry.sources.files import matches_globs

    kept = matches_globs(path, included, excluded)
    return kept if size is None else kept & (F.coalesce(size, F.lit(0)) <= MOST_BYTES)
