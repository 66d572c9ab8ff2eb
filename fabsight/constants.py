"""Results depend on these exact numbers, words and patterns."""

CHANNELS = ("temperature", "pressure", "rf_power", "gas_flow")
INTERVAL_SECONDS = 5

WINDOW, STRIDE, CONFIRM_K = 12, 6, 2
EWMA_ALPHA, SCORE_CLIP = 0.1, 3.0
EXCERPT_CHARS = 240
LOOKBACK_ROWS = 300
TRANSITION_THRESHOLD, TRANSITION_SETTLE = 1000.0, 10
VAR_LAG, VAR_RIDGE = 2, 1e-6
PCA_VARIANCE, LIMIT_QUANTILE = 0.9, 0.999
CALIBRATION_LOW, CALIBRATION_HIGH = 0.5, 1.5
MIN_TRAIN_WINDOWS, MIN_CALIBRATION_WINDOWS = 200, 200
WARMUP_TAUS, MIN_STEADY_WINDOWS = 5, 100
REFIT_RECENCY_DAYS, STALE_HOURS = 14, 168

SENSOR_ROW_BUDGET = 500
SUMMARY_REPAIRS = 100
NOTIFICATION_BUCKET_SECONDS = 1800
LOCAL_ZONE = "Asia/Seoul"

TOP_K, MIN_SCORE, FUSION_ALPHA, RERANK_POOL = 3, 0.2, 0.5, 10
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25

VARIANCE_HISTORY, VARIANCE_MIN_SAMPLES = 8, 5
VARIANCE_FACTOR = 2.8284271247461903

# process type -> channel -> (mu0, sigma, band_half, lsl, usl, drift_rate)
PROFILES = {
    "Etching": {
        "temperature": (60.0, 0.10, 0.30, 58.5, 61.5, 0.03),
        "pressure": (42.0, 0.67, 2.0, 30.0, 55.0, 0.40),
        "rf_power": (2.79, 0.027, 0.08, 2.45, 3.05, -0.006),
        "gas_flow": (606.0, 3.0, 9.0, 540.0, 660.0, -2.0),
    },
    "Deposition": {
        "temperature": (45.0, 0.10, 0.30, 43.5, 46.5, 0.03),
        "pressure": (30.0, 0.50, 1.5, 22.0, 40.0, 0.30),
        "rf_power": (1.80, 0.020, 0.06, 1.55, 2.05, -0.004),
        "gas_flow": (400.0, 2.5, 7.5, 350.0, 450.0, -1.5),
    },
}
DEFAULT_PROCESS = "Etching"

ALARM_PRIORITY = {
    "ERR-402": 1, "ERR-401": 2, "ERR-301": 2, "ERR-201": 3, "WRN-501": 4,
    "WRN-701": 5, "WRN-702": 5, "WRN-703": 5, "WRN-704": 5, "WRN-801": 6,
}
ACUTE_CODES = {"temperature": "ERR-401", "pressure": "ERR-301", "rf_power": "ERR-201", "gas_flow": "WRN-501"}
DRIFT_CODES = {"temperature": "WRN-701", "pressure": "WRN-702", "rf_power": "WRN-703", "gas_flow": "WRN-704"}
VARIANCE_CODE, COOLING_CODE, ANOMALY_CODE = "WRN-801", "ERR-402", "WRN-901"
CRITICAL_CODES = ("ERR-402",)

ALARM_TEXTS = {
    "ko": {
        "ERR-401": "온도 위험 기준 초과",
        "ERR-301": "압력 위험 기준 초과",
        "ERR-201": "RF 파워 위험 기준 초과",
        "WRN-501": "가스 유량 경고 기준 이탈",
        "WRN-701": "온도 드리프트 감지",
        "WRN-702": "압력 드리프트 감지",
        "WRN-703": "RF 파워 드리프트 감지",
        "WRN-704": "가스 유량 드리프트 감지",
        "ERR-402": "냉각 이상 (온도 상승·압력 하강)",
        "WRN-801": "센서 변동성 증가 (값은 정상 범위, 신호 흔들림 급증)",
        "WRN-901": "다변량 이상 감지 (센서 상관 붕괴)",
        "ERR-901": "다변량 이상 (센서 상관 붕괴)",
    },
    "en": {
        "ERR-401": "Temperature exceeded critical threshold",
        "ERR-301": "Pressure exceeded critical threshold",
        "ERR-201": "RF power exceeded critical threshold",
        "WRN-501": "Gas flow out of warning band",
        "WRN-701": "Temperature drift detected",
        "WRN-702": "Pressure drift detected",
        "WRN-703": "RF power drift detected",
        "WRN-704": "Gas flow drift detected",
        "ERR-402": "Cooling anomaly (temperature rise, pressure drop)",
        "WRN-801": "Sensor variability increase (values in range, fluctuation spike)",
        "WRN-901": "Multivariate anomaly detected (sensor correlation breakdown)",
        "ERR-901": "Multivariate anomaly (sensor correlation breakdown)",
    },
}
UNKNOWN_ALARM_SUFFIX = {"ko": "알람 발생", "en": "alarm raised"}
DEFAULT_LOCALE = "ko"

CHECKLISTS = {
    "ko": {
        "ERR-401": ["온도 센서 실측값 확인", "냉각·가열 계통 이상 여부 점검"],
        "ERR-301": ["압력 센서 실측값 확인", "압력 밸브·배관 누설 점검"],
        "ERR-201": ["RF 파워 출력 실측값 확인", "RF 매칭·전원부 상태 점검"],
        "WRN-501": ["가스 유량(MFC) 실측값 확인", "가스 라인·밸브 개폐 상태 점검"],
        "WRN-701": ["온도 센서 기준값 재측정", "온도 계통 예방정비(PM) 일정 확인"],
        "WRN-702": ["압력 센서 기준값 재측정", "압력 계통 예방정비(PM) 일정 확인"],
        "WRN-703": ["RF 파워 기준값 재측정", "RF 계통 예방정비(PM) 일정 확인"],
        "WRN-704": ["가스 유량 기준값 재측정", "가스 계통 예방정비(PM) 일정 확인"],
        "ERR-402": ["라인 정지 없이 압력 밸브 상태 확인", "냉각수 유량·온도 점검"],
        "WRN-801": ["센서 신호 노이즈·접점 확인", "주변 진동·간섭원 점검"],
        "WRN-901": ["기여 센서와 연관 채널 간 상관 관계 점검", "공정 레시피 파라미터 확인"],
        "ERR-901": ["RF 파워·온도 상관 점검", "공정 레시피 파라미터 확인"],
    },
    "en": {
        "ERR-401": ["Verify temperature sensor reading", "Inspect cooling/heating system"],
        "ERR-301": ["Verify pressure sensor reading", "Inspect pressure valve/pipe leakage"],
        "ERR-201": ["Verify RF power output reading", "Inspect RF matching/power supply"],
        "WRN-501": ["Verify gas flow (MFC) reading", "Inspect gas line/valve open-close state"],
        "WRN-701": ["Re-measure temperature sensor baseline", "Check temperature system PM schedule"],
        "WRN-702": ["Re-measure pressure sensor baseline", "Check pressure system PM schedule"],
        "WRN-703": ["Re-measure RF power baseline", "Check RF system PM schedule"],
        "WRN-704": ["Re-measure gas flow baseline", "Check gas system PM schedule"],
        "ERR-402": ["Check pressure valve state without stopping the line", "Inspect coolant flow/temperature"],
        "WRN-801": ["Check sensor signal noise/contacts", "Inspect nearby vibration/interference"],
        "WRN-901": ["Check correlation between the contributing sensor and related channels", "Verify process recipe parameters"],
        "ERR-901": ["Check RF power/temperature correlation", "Verify process recipe parameters"],
    },
}
CHECKLIST_TAIL = {
    "ko": ["점검 결과를 작업 로그에 등록", "동일 알림 재발 시 재점검 실행"],
    "en": ["Register inspection result in work log", "Re-check if the same alert recurs"],
}
ALARM_CHANNELS = {
    "ERR-401": ["temperature"], "ERR-301": ["pressure"], "ERR-201": ["rf_power"], "WRN-501": ["gas_flow"],
    "WRN-701": ["temperature"], "WRN-702": ["pressure"], "WRN-703": ["rf_power"], "WRN-704": ["gas_flow"],
    "ERR-402": ["temperature", "pressure"], "ERR-901": ["rf_power", "temperature"],
    "WRN-801": [], "WRN-901": [],
}

DIAGNOSTIC_SIGNAL = (
    r"(설비|장비|센서|알람|경보|온도|압력|진동|이상|불안정|징후|원인|조치|진단|상태|"
    r"로그|이력|정비|수리|고장|점검|매뉴얼|라인|EQP-|ERR-|WRN-|line)"
)
SMALLTALK_SIGNAL = (
    r"(안녕|안뇽|하이|헬로|반가|반갑|고마워|고맙|감사|수고|잘\s*부탁|처음\s*뵙|"
    r"잘\s*있어|또\s*봐|^ㅎㅇ$|^hi$|^hello$|^hey$|^thanks$|^thank\s*you$|^bye$)"
)
FOLLOWUP_REFERENCE = (
    r"((그|이|저)\s*(거|것|건|걸|값|때|부분|내용|결과)|아까|방금|조금\s*전|직전|이전|"
    r"앞서|어제|그저께|지난|다시|나머지|같은\s*거|(그\s*)?다음\s*(거|것|건|걸|번|단계))"
)
REQUEST_CLAUSE = (
    r"(보여|알려|뽑아|그려|찾아|정리|비교|분석|확인|조회|출력|어떻게\s*됐|해줘|해주세요)"
)

PERIOD_PATTERN = r"(\d+)\s*(분|시간|일|주일|주|개월|달|년)"
UNIT_DAYS = {"분": 1 / 1440, "시간": 1 / 24, "일": 1.0, "주": 7.0, "주일": 7.0, "개월": 30.0, "달": 30.0, "년": 365.0}
RELATIVE_DAYS = {
    "이번주": 7.0, "이번 주": 7.0, "지난주": 7.0, "지난 주": 7.0, "한주": 7.0, "한 주": 7.0, "일주일": 7.0,
    "주간": 7.0, "이번달": 30.0, "이번 달": 30.0, "지난달": 30.0, "지난 달": 30.0, "한달": 30.0,
    "한 달": 30.0, "월간": 30.0, "연간": 365.0,
}
MAINTENANCE_HINT = "정비|수리|교체"

EQUIPMENT_PATTERN = r"EQP-[A-Z0-9]{3}"
ALARM_PATTERN = r"(?:ERR|WRN)-\d{3}"
