"""Small inputs of the queries: dictionaries and text vectors with their expected results."""

# A dictionary and vectors (name, text, masked, restored or None for the text itself).
PARITY_YAML = r"""
INTERNAL:
  - 알파테크
  - {term: 알파, boundary: strict}
PROJECT:
  - Project 오로라, 오로라
CUSTOMER:
  - CORP
PHONE:
  patterns:
    - '\b01[016-9][-\s]?\d{3,4}[-\s]?\d{4}\b'
EMAIL:
  patterns:
    - '\b[\w.+-]+@[\w-]+\.[\w.-]+\b'
"""
PARITY_VECTORS = [
    ("korean-particle", "알파테크는 Project 오로라를 검토했다", "<INTERNAL_1A>는 <PROJECT_1A>를 검토했다", None),
    ("ascii-boundary", "CORP와 CORPORATION", "<CUSTOMER_1A>와 CORPORATION", None),
    ("strict-blocks-hangul-prefix", "글로벌알파", "글로벌알파", None),
    ("alias-canonical", "오로라 일정", "<PROJECT_1B> 일정", None),
    ("phone-pattern", "연락처 010-1234-5678", "연락처 <PHONE_1A>", None),
    ("email-pattern", "메일 hong@example.com 참조", "메일 <EMAIL_1A> 참조", None),
    ("multi-category-order", "알파테크 CORP 010-1234-5678", "<INTERNAL_1A> <CUSTOMER_1A> <PHONE_1A>", None),
    ("escaped-token-input", "이미 <PROJECT_9> 있음", "이미 <<PROJECT_9>> 있음", "이미 <PROJECT_9> 있음"),
    ("no-match", "오늘 날씨가 맑습니다", "오늘 날씨가 맑습니다", None),
    ("empty", "", "", None),
]
#: A dictionary for the documents table: common words as terms, personal data as patterns.
DOCUMENTS_YAML = r"""
PHRASE:
  - the, that
  - for
LICENSE:
  - MIT License, General Public License
EMAIL:
  patterns:
    - '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]'
IP:
  patterns:
    - '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}'
SECRET:
  patterns:
    - '[0-9a-f]{40}'
"""
