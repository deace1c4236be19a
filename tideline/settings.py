"""Parameters of the jobs, and the fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ScreenSettings:
    lookback_days: int = 130
    min_history: int = 60
    min_market_cap: float = 100_000_000_000
    min_avg_turnover: float = 1_000_000_000
    momentum_ret20: float = 0.15
    high_proximity: float = 0.97
    volume_surge_ratio: float = 2.5
    golden_cross_window: int = 7
    top_n: int = 30


@dataclass(frozen=True)
class HorizontalSettings:
    beta_window: int = 120
    gap_window: int = 5
    min_abs_corr: float = 0.2
    min_group_corr: float = 0.3
    min_group_move: float = 0.02
    min_valid_ratio: float = 0.8
    min_group_members: int = 3
    unreacted_gap: float = 0.03
    max_peers: int = 6


@dataclass(frozen=True)
class LagSettings:
    min_members: int = 2
    max_lag: int = 20
    min_obs: int = 60
    block_days: int = 21
    max_lag_blocks: int = 18
    min_obs_blocks: int = 24
    max_overlap: float = 0.5
    weak_corr: float = 0.15
    discovery_limit: int = 40


@dataclass(frozen=True)
class GraphSettings:
    map_confidence: float = 0.5
    theme_confidence: float = 0.70
    basket_confidence: float = 0.55
    profile_confidence: float = 0.6
    trade_confidence: float = 0.8
    contract_confidence: float = 0.9
    factor_confidence_cap: float = 0.9
    min_confidence: float = 0.0
    max_members: int = 8
    max_drivers: int = 6
    max_candidates: int = 20
    chain_caps: tuple[int, ...] = (5, 4, 3)


@dataclass(frozen=True)
class NewsSettings:
    per_name: int = 8
    days: int = 14
    filing_days: int = 14


@dataclass(frozen=True)
class ContractSettings:
    max_ratio_pct: float = 10_000.0
    min_plausible_sales: float = 100_000_000.0


@dataclass(frozen=True)
class Settings:
    screen: ScreenSettings = field(default_factory=ScreenSettings)
    horizontal: HorizontalSettings = field(default_factory=HorizontalSettings)
    lags: LagSettings = field(default_factory=LagSettings)
    graph: GraphSettings = field(default_factory=GraphSettings)
    news: NewsSettings = field(default_factory=NewsSettings)
    contracts: ContractSettings = field(default_factory=ContractSettings)


# ---- Fixed values -------------------------------------------------------------------------
# Words, labels and patterns below must equal the published behaviour for results to match.

REL_MEMBER = "소속"
REL_UPSTREAM = "후방"
REL_DOWNSTREAM = "전방"
REL_EXPOSURE = "노출"
RELATIONS = (REL_MEMBER, REL_UPSTREAM, REL_DOWNSTREAM, REL_EXPOSURE)
PERSISTENT_SOURCES = ("valuechain", "dart", "llm", "profile", "contract", "preferred")

TRIGGER_MOMENTUM = "강세지속"
TRIGGER_TURNAROUND = "상승전환"
ATTRIBUTION_CONFIRMED = "부문확인"
ATTRIBUTION_GUESSED = "추정"
SKIP_OVERLAP = "구성 중복"
INDUSTRY_GROUP_PREFIX = "산업:"
THEME_GROUP_PREFIX = "테마:"
BASKET_GROUP_PREFIX = "ETF:"
MARKET_FACTOR = "시장"
PEER_LABEL = "동종"
DRIVER_LABEL = "동인:"

TIER_CONFIDENCE = {"A": 0.85, "B": 0.70, "C": 0.55}
DEFAULT_TIER_CONFIDENCE = 0.55

STANDARD_CODE = r"^KR[A-Z0-9](\d{6})\d{3}$"
SHORT_CODE = r"^[0-9][0-9A-Z]{5}$"
EXPLICIT_TICKER = r"^(.*?)\(([0-9][0-9A-Z]{5})\)$"
BASKET_MEMBER_CODE = r"^\d{6}$"
NAME_NOISE = r"\s|㈜|\(주\)|（주）|주식회사"
PREFERRED_NAME = r"\d*우[A-Z]?(?:\(.*\))?$"
NO_VALUE_CHAIN_NAME = (
    r"금융$|금융지주|은행$|은행지주|증권$|보험$|생명$|화재$|해상화재|손해보험|캐피탈$|"
    r"자산운용|저축은행|카드$|스팩|제\d+호|리츠$")
BROAD_BASKET_NAME = (
    r"(?i)미국|차이나|중국|일본|인도|베트남|유럽|글로벌|선진|신흥|아시아|나스닥|S&P|다우|"
    r"달러|엔화|유로|채권|국고채|국채|통안|회사채|금리|CD금리|KOFR|단기자금|머니마켓|"
    r"원유|WTI|골드|금선물|은선물|구리|니켈|농산물|콩|옥수수|천연가스|팔라듐|플래티넘|"
    r"레버리지|인버스|2X|3X|커버드콜|"
    r"코스피200|KRX300|코스닥150|MSCI|고배당|배당성장|가치주|퀄리티|모멘텀|저변동|로우볼")

INDUSTRY_NOISE = r"[\s·,/\-—()·]"
INDUSTRY_SUFFIX = r"(?:제조업|사업부문|사업부|산업|부문|사업|업계)$"

MIN_QUOTE_CHARS = 10
MIN_NUMERIC_QUOTE_CHARS = 6
DROP_RATE_ALERT = 0.3

PARTICLES = (
    "은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "도",
    "로", "으", "만", "부터", "까지", "에서", "보다", "라", "랑",
    "께", "한테", "처럼", "마다", "조차", "밖에", "이라", "이나", "나")
MARKET_KEYWORDS = (
    r"주가|급등|급락|상한가|하한가|신고가|목표주가|증권|애널리스트|투자의견|"
    r"코스닥|코스피|상장|공시|거래량|시가총액|배당|자사주|유상증자|무상증자|"
    r"수주|계약|납품|공급|실적|매출|영업이익|적자|흑자|증설|가동|양산|수출|"
    r"인수|합병|지분|매각|신제품|출시|임상|허가|승인|특허|리콜|파업|화재|"
    r"목표가|어닝|가이던스|단가|판가")

SECTION_START = r"(?:^|\n)[ \t]*(?:Ⅱ|II|2)[.\s][ \t.]{0,3}\s*사업의\s*내용"
SECTION_END = r"(?:^|\n)[ \t]*(?:Ⅲ|III|3)[.\s][ \t.]{0,3}\s*(?:재무에\s*관한\s*사항|재무제표)"
MIN_SECTION_CHARS = 200
MAX_HEADING_TAIL = 12
SUBSECTION_LINE = (
    r"^[ \t|]*\(?(?:\d{1,2}|[가-하]|[IVXivx]{1,4})[.)]\s*"
    r"([^\n|0-9]{2,30}?)\s*[ \t|]*$")
SUBSECTION_KEEP = (
    r"사업의\s*개요|사업\s*개요|주요\s*제품|제품\s*및\s*서비스|"
    r"원재료|생산설비|생산\s*및\s*설비|매출|수주|시장\s*점유|"
    r"주요\s*계약|영업의\s*개황")
MIN_SUBSECTIONS = 3
MIN_KEPT_CHARS = 800
DIGEST_KEEP = r"사업의\s*개요|사업\s*개요|주요\s*제품|제품\s*및\s*서비스|매출실적"
DIGEST_DROP = (
    r"생산\s*설비|생산\s*및\s*설비|유형\s*자산|무형\s*자산|가격\s*변동\s*추이|"
    r"용어\s*해설|용어\s*설명|주요\s*용어")
PRODUCT_CUE = (
    r"제조|생산|판매|공급|영위|주력|전문\s*기업|주요\s*제품|품\s*목|사업부문|"
    r"솔루션|서비스를\s*제공")
SELF_REFERENCE = r"당사|당행|연결실체|연결회사"
DIGEST_BUDGET = 1200
DIGEST_BLOCK_BUDGET = 900

REPORT_PRIORITY = ("사업보고서", "반기보고서", "분기보고서")

CONTRACT_FILING_NAMES = ("단일판매", "공급계약", "수주")
CONTRACT_FIELDS = {
    "counterparty": r"계약\s*상대(?:방|)",
    "product": r"(?:판매·?공급\s*계약\s*내용|계약\s*내용|공급\s*품목|계약\s*목적물)",
    "amount": r"계약\s*금액",
    "recent_sales": r"최근\s*매출액",
    "ratio": r"매출액\s*대비",
    "begin": r"(?:계약\s*)?시작일",
    "end": r"(?:계약\s*)?종료일",
    "period": r"계약\s*기간",
    "region": r"판매·?공급\s*지역",
}
CONTRACT_DATE = r"(\d{4})\s*[-.년/]\s*(\d{1,2})\s*[-.월/]\s*(\d{1,2})"
CONTRACT_FOOTNOTE = r"\(단위|(?<![(가-힣])주\d*\)|※|비고"
CONTRACT_EDGE_NOISE = r"^[\s:：·\-]+|[\s:：·\-]+$"
CONTRACT_BOILERPLATE = r"입니다|상기\s*\d|해당사항|기재하지|참조|공시유보|계약을\s*체결"

COUNTERPARTY_ALIASES = {
    "POSCO": "POSCO홀딩스",
    "포스코": "POSCO홀딩스",
    "현대차": "현대자동차",
    "기아차": "기아",
    "LG화학": "LG화학",
    "SK하이닉스": "SK하이닉스",
    "하이닉스": "SK하이닉스",
    "삼성전자": "삼성전자",
    "LG엔솔": "LG에너지솔루션",
    "한국조선해양": "HD한국조선해양",
    "현대중공업": "HD현대중공업",
    "두산에너빌리티": "두산에너빌리티",
}
COUNTERPARTY_GENERIC = (
    r"(전방|후방|재료|소재|부품|장비|기타)?산업|업체|제조사|고객사|"
    r"거래처|매출처|공급사|조선사|건설사|완성차")
COUNTERPARTY_SPLIT = r"[·・,/()（）\[\]{}\s、;:]+"
COUNTERPARTY_QUOTES = "’'\"“”·"
MIN_COUNTERPARTY_CHARS = 3

CAUSE_TYPES_REQUIRED = (
    "cause_summary", "cause_type", "cause_scope", "industry",
    "evidence", "confidence", "ripple_axis", "ripple_paths")
CAUSE_TYPES = (
    "실적서프라이즈", "수주·공급계약", "업황개선(P/Q/C)", "정책·규제",
    "테마·수급", "M&A·지배구조", "무재료·기술적")
SCOPE_COMPANY = "회사고유"
SCOPE_INDUSTRY = "산업공통"
CONFIDENCE_LEVELS = ("높음", "중간", "낮음")
RIPPLE_AXES = ("수직", "수평", "양쪽", "해당없음")
IDEA_AXES = ("수직", "수평")
DIRECTIONS = ("동종업계", "전방산업", "후방산업", "공통동인")
IMPACT_GAIN = "수혜"
IMPACT_LOSS = "피해"
PRICED_IN = ("미반영", "일부반영", "기반영", "확인불가")
SYNTHESIS_REQUIRED = ("market_summary", "ideas")
PROVENANCE_GRAPH = "그래프기반"
PROVENANCE_MODEL = "LLM창작"
# ---- end of fixed values ------------------------------------------------------------------
