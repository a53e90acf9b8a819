"""Word lists and patterns that define behaviour: what a text's domain is, what a question asks for, what a fact looks like.

"""

from __future__ import annotations

#: domain -> terms; the order of the domains settles ties
DOMAIN_TERMS = {
    "legal": (
        "agreement arbitration article breach clause herein indemnify jurisdiction liability notwithstanding pursuant termination thereof warranty whereas "
        "갑 계약 고시 관할 권리 규정 당사자 법률 별첨 소송 손해배상 시행령 약정 위약금 을 의무 조 조항 준거법 판례 항 해제 해지 호"
    ).split(),
    "financial": (
        "amortization annual asset budget cagr capex dividend ebitda fiscal margin opex pbr per profit quarterly revenue roe roi "
        "결산 당기순이익 대차대조표 매출 배당 부채 비용 성장률 손익계산서 수익률 시가총액 영업이익 예산 이자 자본 자산 재무제표 전년대비 투자 현금흐름"
    ).split(),
    "medical": (
        "adverse clinical contraindication diagnosis dosage efficacy pathology patient pharmaceutical prognosis symptom treatment trial "
        "검사 병력 부작용 수술 시험 약물 임상 증상 진단 처방 치료 투여 환자 효능"
    ).split(),
    "technical": (
        "api branch ci/cd class cluster commit container deploy docker endpoint function kubernetes merge module nginx repository sdk terraform "
        "데이터베이스 도커 마이크로서비스 배포 서버 아키텍처 인프라 컨테이너 쿠버네티스 파이프라인"
    ).split(),
    "support": "as customer escalation faq inquiry q&a refund request resolution sla ticket 결제 고객 교환 답변 문의 반품 배송 상담 요청 접수 처리 환불".split(),
}
#: domain -> fusion weights of the vector, question and keyword list
DOMAIN_WEIGHTS = {"legal": (0.2, 0.2, 0.6), "financial": (0.3, 0.3, 0.4), "support": (0.2, 0.6, 0.2), "technical": (0.5, 0.25, 0.25)}
PLAIN_WEIGHTS = (0.4, 0.35, 0.25)

#: which kinds of facts a text can hold
FACT_DOMAINS = {
    "security": r"(?i)CVE-|CORS|SEC-[0-9]{3}|SQL\s*Injection|보안\s*(?:감사|이슈)|취약점",
    "finance": r"ARR|Series\s*[A-D]|런웨이|매출|비용|소진율|예산|투자|파이프라인|현금",
    "hr": "부서|인원|조직|직급|채용|팀장|헤드카운트",
    "product": r"(?i)changelog|v[0-9]{1,18}\.[0-9]|릴리스|버그\s*수정|버전|변경\s*이력|신기능",
    "patent": r"IP\s*현황|PAT-[0-9]{3}|PCT|등록|발명자|출원|특허",
    "contract": r"Enterprise|PoC|Pro|계약|고객사|온프레미스|월\s*매출|클라우드",
}
SEVERITY = {"critical": "Critical", "심각": "Critical", "high": "High", "높음": "High", "medium": "Medium", "중간": "Medium", "보통": "Medium", "low": "Low", "낮음": "Low"}
LEVELS = ("Critical", "High", "Medium", "Low")
LEVELS_KO = {"Critical": "심각", "High": "높음", "Medium": "중간", "Low": "낮음"}
SEVERITY_WORD = r"((?i:Critical|High|Low|Medium)|낮음|높음|보통|심각|중간)"
STATUS_STATED = r"(?:조치\s*상태|상태)\s*[:：]?\s*(?:([0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2})\s*)?(완료|미조치|진행\s*중|예정|보류)"
STATUS_SYNONYMS = {
    "완료": ("조치 완료된", "조치 완료", "해결됨", "처리 완료"),
    "미조치": ("미해결", "대기 중", "미완료", "조치 미완료"),
    "진행 중": ("진행중", "처리 중", "작업 중"),
    "진행중": ("진행 중", "처리 중", "작업 중"),
    "예정": ("계획됨", "계획", "예정된"),
    "보류": ("보류 중", "일시 중단"),
}
STATUS_HEADINGS = ("확정", "진행 중", "진행중", "계획", "예정", "완료", "보류", "검토", "미정")
TEMPORAL = "변화량|추이|분기|연간|반기별|기간별|연도별|월별|일별|주별"
