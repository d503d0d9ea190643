"""Rules: patterns, keep lists, known hosts, policies.  Small tables for the driver; scans carry them as literals."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
CATEGORIES = ["SECRET", "PII", "ORG_NAME", "DICTIONARY", "ENDPOINT", "BRAND_IDENTIFIER", "BRAND_PATH", "PACKAGE_NAMESPACE"]
#: Found and gated, never rewritten.
DETECTION_ONLY = ["BRAND_IDENTIFIER", "BRAND_PATH", "PACKAGE_NAMESPACE"]


@dataclass(frozen=True)
class Rule:
    """A pattern.  route: how it is rewritten; group: what of the match is the value, which ends ``trail`` signs before the
    match; guard: literals of which any match holds one, compared in lower case if ``fold``; scan: where
    there are no literals, a cheap pattern found in any match."""

    name: str
    pattern: str
    category: str = "SECRET"
    severity: str = "CRITICAL"
    route: str = "named"
    group: int = 0
    trail: int = 0
    guard: tuple[str, ...] = ()
    fold: bool = False
    scan: str = ""


_NOT_WORD_BEFORE, _NOT_WORD_AFTER = r"(?<![A-Za-z\d])", r"(?![A-Za-z\d])"
KEYWORDS = "access[-_]?key(?:[-_]?id)?|apikey|(?:api|app)[-_]?key|auth[-_]?(?:token|key)|client[-_]?secret|pass(?:phrase|word|wd)|private[_-]?key|pwd|secret(?:[_-]?key)?|token|[-._]salt"
_NOT_MASKED = r"(?!ANON_(?:ORG|PER)_|Author_|REDACTED_|TERM_|author_|user_[\da-f])"
_NOT_PLACEHOLDER = r"(?!(?:0{4,}\b|ENV\[|[Xx*]{3,}\b|app[-_](?:secret|key|id)\b|change[-_]?me|config\(|disabled|enabled|env\(|example|false|getenv|nil|none|null|os[.]environ|password\b|placeholder|process[.]env|secret\b|token\b|true|undefined|your[-_])[\s\"',;#}]?)"
_URL_REST = r"[^\s\"'<>]+"
_PARAMS = "access[-_]?token|api[-_]?key|auth|client[-_]?secret|credential|key|pass(?:wd|word)|pwd|secret|security[-_]?token|sig(?:nature)?|token|x-amz-(?:credential|security-token|signature)|x-goog-signature"


_KEY_NAMES = tuple(a + sep + b for a, b in (("api", "token"), ("api", "key"), ("access", "token"), ("auth", "token"), ("private", "key"), ("secret", "key")) for sep in ("", "-", ".", "_"))


def _pii(name, pattern, severity="HIGH", **more):
    return Rule(name, pattern, "PII", severity, **more)


def _endpoint(name, schemes, guard, severity="HIGH", pattern=None):
    return Rule(name, pattern or f"{schemes}://{_URL_REST}", "ENDPOINT", severity, "host", guard=guard)


RULES: list[Rule] = [
    _pii("email", r"[+%.\w-]+@(?:[A-Za-z\d-]+[.])+(?!invalid\b)[A-Za-z]{2,}(?![A-Za-z\d]|[.][A-Za-z\d]|:[^@\s]*/)", route="email", guard=("@",)),
    _pii("phone_e164", _NOT_WORD_BEFORE + r"[+][1-9]\d{6,14}" + _NOT_WORD_AFTER, route="phone", guard=("+",)),
    _pii("phone_ru", _NOT_WORD_BEFORE + r"(?:[+]7|8)[-\s]?[(]?\d{3}[)]?(?:[-\s]?\d{3})(?:[-\s]?\d{2}){2}" + _NOT_WORD_AFTER, route="phone", scan=r"\d{3}"),
    _pii("ssn", r"\b(?!9\d\d|666|000)\d{3}-(?!00)\d\d-(?!0{4})\d{4}\b", "CRITICAL", guard=("-",)),
    _pii("credit_card", r"\b(?:3[47]\d\d|4\d{3}|5[1-5]\d\d|6011|65\d\d)(?:[-\s]?\d{4}){2}[-\s]?\d{3,4}\b", "CRITICAL", route="luhn", scan=r"\d{4}"),
    _pii("iban", r"\b[A-Z]{2}\d\d[\dA-Z]{4}\d{7}[\dA-Z]{0,16}\b", scan=r"\d{7}"),
    _pii("passport_ru", r"\b\d\d\d\d\s\d{6}\b", "CRITICAL", scan=r"\d{6}"),
    _pii("inn_ru", r"\b(?:INN|ИНН)[\s:]*\d{10,12}\b", guard=("INN", "ИНН")),
    _pii("ogrn_ru", r"\b(?:OGRN|ОГРН)(?:IP|ИП)?[\s:№]*\d{13}(?:\d\d)?\b", guard=("OGRN", "ОГРН")),
    _pii("kpp_ru", r"\b(?:KPP|КПП)[\s:№]*\d{9}\b", guard=("KPP", "КПП")),
    _pii("fio_ru", r"(?<![А-яЁё])(?:[ЁА-Я][ёа-я]+\s+){1,2}[ЁА-Я][ёа-я]+(?:[ое]вич|[ое]вна|ична|кызы|оглы|ьич)(?:\s+[ЁА-Я][ёа-я]+)?(?![А-яЁё])", guard=("вна", "вич", "ьич", "ична", "оглы", "кызы")),
    Rule("jwt", r"eyJ[\w-]{10,}(?:[.][\w-]{10,}){2}", guard=("eyJ",)),
    Rule("pem_private_key", r"-{5}BEGIN [ A-Z]*PRIVATE KEY-{5}", guard=("PRIVATE KEY",)),
    Rule("aws_access_key_id", r"\bA(?:GPA|IDA|IPA|KIA|NPA|NVA|PKA|ROA|SIA)[A-Z\d]{16}\b", guard=("AGPA", "AIDA", "AIPA", "AKIA", "ANPA", "ANVA", "APKA", "AROA", "ASIA")),
    Rule("aws_secret_key", r"(?:aws[-._]?secret[-._]?(?:access[-._]?)?key|AWS_SECRET[-._]?ACCESS[-._]?KEY)[\s\":=]+([+/=A-Za-z\d]{40})", route="grouped", group=1, guard=("aws", "AWS")),
    Rule("github_token", r"gh[oprsu]_[A-Za-z\d]{36,255}", guard=("gho_", "ghp_", "ghr_", "ghs_", "ghu_")),
    Rule("github_pat_v2", r"github_pat_\w{82}", guard=("github_pat_",)),
    Rule("gitlab_token", r"glpat-[\w-]{20}", guard=("glpat-",)),
    Rule("slack_token", r"xox[abprs](?:-\d{10,13}){2}-[A-Za-z\d]{24}", guard=("xox",)),
    Rule("slack_webhook", r"https://hooks[.]slack[.]com/services/T[A-Za-z\d]+/B[A-Za-z\d]+/[A-Za-z\d]+", guard=("hooks.slack.com",)),
    Rule("stripe_live_key", r"sk_live_[A-Za-z\d]{24,}", guard=("sk_live_",)),
    Rule("stripe_test_key", r"sk_test_[A-Za-z\d]{24,}", severity="HIGH", guard=("sk_test_",)),
    Rule("stripe_publishable_key", r"pk_(?:test|live)_[A-Za-z\d]{24,}", severity="MEDIUM", guard=("pk_live_", "pk_test_")),
    Rule("sendgrid_api_key", r"SG[.][\w-]{22}[.][\w-]{43}", guard=("SG.",)),
    Rule("google_api_key", r"AIza[\w-]{35}", guard=("AIza",)),
    Rule("google_oauth_token", r"ya29[.][\w-]{50,}", guard=("ya29.",)),
    Rule("npm_token", r"npm_[A-Za-z\d]{36}", guard=("npm_",)),
    Rule("pypi_token", r"pypi-[\w-]{40,}", guard=("pypi-",)),
    Rule("twilio_sid", r"\bAC[\da-f]{32}\b", severity="HIGH", guard=("AC",)),
    Rule("mailchimp_api_key", r"[\da-f]{32}-us\d{1,2}", severity="HIGH", guard=("-us",)),
    Rule("telegram_bot_token", r"\b\d{9,10}:[\w-]{35}\b", guard=(":",)),
    Rule("generic_api_key", r"(?i)(?:api[-._]?(?:token|key)|access[-._]?token|auth[-._]?token|private[-._]?key|secret[-._]?key)[\s\":=]+[\"']([\w+/=-]{20,})[\"']", severity="HIGH", route="grouped", group=1, trail=1, guard=_KEY_NAMES, fold=True),
    Rule("config_assignment_secret", rf"(?i)\b[.\w]*(?:{KEYWORDS})\b[\"']?\s*[=:]\s*[\"']?{_NOT_MASKED}{_NOT_PLACEHOLDER}([\w!#&*+./:=@^|~-]{{5,}})", severity="HIGH", route="grouped", group=1, guard=("pass", "pwd", "secret", "token", "key", "salt"), fold=True),
    Rule("basic_auth_in_url", r"https?://[\w%+.-]+:[\w!#$%&()*+.@^-]{4,}@[A-Za-z\d.-]+", route="host", guard=("://",)),
    Rule("secret_url_param", rf"(?i)[&?](?:{_PARAMS})=[^\s\"'&<>]+", severity="HIGH", route="param", guard=("=",)),
    _endpoint("db_connection_postgresql", "postgres(?:ql)?", ("postgres",)),
    _endpoint("db_connection_mysql", "mysql(?:[+][a-z]+)?", ("mysql",)),
    _endpoint("db_connection_mongodb", "mongodb(?:[+]srv)?", ("mongodb",)),
    _endpoint("db_connection_redis", "rediss?", ("redis",)),
    _endpoint("db_connection_amqp", "amqps?", ("amqp",)),
    _endpoint("jdbc_url", "jdbc:[a-z]+", ("jdbc:",)),
    _endpoint("internal_corp_url", "", (".corp", ".internal", ".intranet", ".lan", ".local"), "MEDIUM", r"https?://[.a-z\d-]+[.](?:corp|internal|intranet|lan|local)[\s/\"'<>]?"),
]
#: Rules whose hit on a kept host is no finding.
HOST_RULES = {r.name for r in RULES if r.name.startswith("db_connection_") or r.name == "jdbc_url"}
BY_NAME = {r.name: r for r in RULES}

INTERNAL_TLDS = ["corp", "internal", "intra", "lan", "local"]
GENERIC_INTERNAL = sorted("api.local app.local dev.local docker.for.mac.localhost docker.for.win.localhost docker.internal env.local gateway.docker.internal host.docker.internal host.minikube.internal kubernetes.docker.internal localhost.local test.local vm.docker.internal web.local".split())
GENERIC_LABELS = sorted(
    "admin amqp api app auth backend broker cache consul database db elastic elasticsearch etcd frontend gateway grafana httpd kafka kibana local localdomain localhost mail mailhog mariadb memcached minio mongo mongodb mq mysql "
    "nginx node pg postgres postgresql prometheus proxy queue rabbitmq redis registry server smtp test traefik ui vault web worker www zookeeper".split()
)
UNIVERSAL_HOSTS = sorted(
    "alpinelinux.org android.com apache.org bitbucket.org bootstrapcdn.com cdnjs.cloudflare.com crates.io deb.nodesource.com debian.org discord.com discord.gg discordapp.com dl.yarnpkg.com docker.com docker.io example.com example.edu "
    "example.invalid example.net example.org fedoraproject.org figma.com gcr.io get.symfony.com getcomposer.org getpsalm.org ghcr.io github.com githubusercontent.com gitlab.com go.dev golang.org gradle.org gravatar.com gstatic.com "
    "invalid jitpack.io jsdelivr.net json-schema.org json.schemastore.org k8s.io letsencrypt.org localhost maven.apache.org maven.org microsoft.com nodesource.com notion.com notion.site notion.so npmjs.com npmjs.org ns.adobe.com "
    "nuget.org oasis-open.org packages.microsoft.com packagist.org phar.phpunit.de proxy.golang.org purl.org pypi.org pythonhosted.org quay.io readthedocs.io readthedocs.org registry.k8s.io rubygems.org schema.org schemas.android.com "
    "schemas.microsoft.com schemas.xmlsoap.org schemastore.org sh.rustup.rs slack.com sonatype.org spdx.org sum.golang.org symfony.com t.me telegram.dog telegram.me telegram.org test ubuntu.com unpkg.com w3.org xml.org ya.ru "
    "yandex.com yandex.ru yarnpkg.com".split()
)
LEGAL_FORMS = sorted("ao co company corp corporation gmbh group holding inc llc ltd oao ooo pao plc sa zao ао зао оао ооо пао".split())


@dataclass(frozen=True)
class Policies:
    deny_globs: tuple[str, ...] = (".env", ".env.*", ".mailmap", "CODEOWNERS", "config.*", "*.pem", "*.key")
    allow_suffixes: tuple[str, ...] = (".dist", ".example", ".sample", ".template")
    binary_deny: tuple[str, ...] = ("7z", "bin", "class", "dll", "exe", "gz", "jar", "pyc", "so", "tar", "zip")
    binary_allow: tuple[str, ...] = ("gif", "ico", "jpeg", "jpg", "png", "svg", "woff", "woff2")
    max_file_mb: float = 20.0
    min_person_length: int = 3
    min_score: float = 0.5


@dataclass(frozen=True)
class Rulepack:
    version: str = "1"
    rules: tuple[Rule, ...] = tuple(RULES)
    policies: Policies = field(default_factory=Policies)
    dictionaries: dict[str, tuple[str, ...]] = field(default_factory=dict)
    languages: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def keep(self) -> list[str]:
        return sorted({t.lower() for t in self.dictionaries.get("keep", ())})

    @property
    def domains(self) -> list[str]:
        return sorted({t.lower() for t in self.dictionaries.get("domains", ())})

    def terms(self) -> list:
        """(dictionary, lower-cased term) but for keep and domains, kept terms left out; the first of equal terms."""
        seen, out = set(self.keep), []
        for name, terms in self.dictionaries.items():
            if name not in ("keep", "domains"):
                for t in terms:
                    if t.lower() not in seen:
                        seen.add(t.lower())
                        out.append((name, t.lower()))
        return out

    def only(self, *names: str) -> "Rulepack":
        return replace(self, rules=tuple(r for r in self.rules if r.name in names))
