"""Fixed values.

Every literal below must equal the source analyses for results to match:
band edges, labels, flag texts, score points, weights and cut-offs. They are
kept together, in the order the analyses use them, and are not derived.
The two blanks after a leading digit in band labels are part of the text.
"""

from __future__ import annotations

from datetime import date
from decimal import Decimal

# ---------------------------------------------------------------- fixed values
# As-of date of the fixture data set (replaces CURRENT_DATE).
AS_OF = date(2001, 1, 1)

# Event type and flag values.
EXIT_EVENT = "exit"
YES = "Yes"
NO = "No"
MALE = "Male"
FEMALE = "Female"

# Q06 role-tenure buckets on YearsInCurrentRole: < 1, <= 3, <= 6, else.
ROLE_TENURE_BANDS = [("<", 1, "0  < 1 year"), ("<=", 3, "1  1–3 years"), ("<=", 6, "2  4–6 years")]
ROLE_TENURE_ELSE = "3  7+ years"

# Q10 education code labels (codes outside 1–5 stay NULL).
EDUCATION_LABELS = {1: "Below college", 2: "College", 3: "Bachelor", 4: "Master", 5: "Doctor"}

# Q12 flight-risk points and tiers.
RISK_POINTS_LOW_SCORE = 40      # performance_score < 3
RISK_POINTS_SHORT_TENURE = 25   # YearsAtCompany < 2
RISK_POINTS_OVERTIME = 20       # OverTime = 'Yes'
RISK_POINTS_LOW_SATISFACTION = 15  # JobSatisfaction <= 2
RISK_TIERS = [(75, "Critical"), (50, "High"), (25, "Medium")]
RISK_TIER_ELSE = "Low"

# Q15 role vs department flag.
ROLE_GAP_CUTOFF = -0.3
ROLE_GAP_FLAG = "Below dept avg — review"
ROLE_GAP_OK = "OK"

# Q16 score trend labels.
TREND_DECLINING = "Declining"
TREND_IMPROVING = "Improving"
TREND_STABLE = "Stable"

# Q17 decile bands.
DECILES = 10
DECILE_TOP = "Top 10% — consider fast-track"
DECILE_BOTTOM = "Bottom 10% — PIP review"
DECILE_MID = "Mid tier"

# Q18 company-tenure buckets on YearsAtCompany: < 1, <= 3, <= 6, <= 10, else.
TENURE_BANDS = [("<", 1, "1  < 1 year"), ("<=", 3, "2  1–3 years"), ("<=", 6, "3  4–6 years"),
                ("<=", 10, "4  7–10 years")]
TENURE_ELSE = "5  10+ years"

# Q22 decline severity.
DECLINE_SIGNIFICANT = "Significant decline"   # change <= -2
DECLINE_MILD = "Mild decline"                 # change = -1
DECLINE_OTHER = "Stable / improving"

# Q25 pay-equity flag: absolute gap above 500.
PAY_GAP_TOLERANCE = 500
PAY_GAP_REVIEW = "⚠ Review required"
PAY_GAP_OK = "✓ Within tolerance"

# Q28 pay status.
BELOW_MEDIAN = "Below median"
AT_OR_ABOVE = "At or above"

# Q31 income brackets on MonthlyIncome, all strict: < 2000, < 4000, < 6000, < 10000, else.
INCOME_BANDS = [("<", 2000, "1  < $2K"), ("<", 4000, "2  $2K–$4K"), ("<", 6000, "3  $4K–$6K"),
                ("<", 10000, "4  $6K–$10K")]
INCOME_ELSE = "5  $10K+"

# Q32 job level labels (codes outside 1–5 stay NULL).
JOB_LEVEL_LABELS = {1: "Junior", 2: "Mid", 3: "Senior", 4: "Lead", 5: "Director"}

# Q33 gender balance flags on the female share: < 30, > 70.
FEMALE_SHARE_LOW = 30
FEMALE_SHARE_HIGH = 70
MALE_SKEWED = "⚠ Male-skewed"
FEMALE_SKEWED = "⚠ Female-skewed"
BALANCED = "✓ Balanced"

# Q36 long commute: DistanceFromHome strictly above 20.
LONG_COMMUTE = 20

# Q38 manager stability: ratio below 0.40.
STABILITY_CUTOFF = Decimal("0.40")
STABILITY_RISK = "⚠ Leadership instability risk"
STABILITY_OK = "✓ Stable"

# Q39 / Q40 interpretation texts.
CORR_DISTANCE_TEXT = "Weak positive — not a primary driver"
CORR_INCOME_TEXT = "Negative — higher income = lower attrition likelihood"

# Q42 promotion status: >= 5 years and rating >= 3; >= 5 and < 3; 3 to 4; else.
PROMOTION_OVERDUE_YEARS = 5
PROMOTION_RATING_CUT = 3
PROMOTION_WATCH = (3, 4)
PROMOTION_OVERDUE = "Overdue — high performer"
PROMOTION_STAGNANT = "Stagnant — low performer"
PROMOTION_WATCH_LIST = "Watch list"
PROMOTION_ON_TRACK = "On track"

# Q43 environment satisfaction labels.
ENVIRONMENT_LABELS = {1: "Low", 2: "Medium", 3: "High", 4: "Very High"}

# Q45 engagement: sum of four 1–4 scores, out of 16; bands >= 14, >= 10.
ENGAGEMENT_MAX = 16
ENGAGEMENT_BANDS = [(14, "Highly engaged"), (10, "Moderately engaged")]
ENGAGEMENT_ELSE = "Disengaged"

# Q48 job-hopping bands on NumCompaniesWorked: = 0, = 1, <= 3, <= 6, else.
JOB_HOP_BANDS = [("=", 0, "1  First job ever"), ("=", 1, "2  1 prior company"),
                 ("<=", 3, "3  2–3 prior companies"), ("<=", 6, "4  4–6 prior companies")]
JOB_HOP_ELSE = "5  7+ prior companies"

# Q50 / bonus weighted features: (weight, column, operator, value), in this order.
PROXY_FEATURES = [
    (Decimal("0.20"), "OverTime", "=", "Yes"),
    (Decimal("0.18"), "JobSatisfaction", "<=", 2),
    (Decimal("0.15"), "YearsAtCompany", "<=", 2),
    (Decimal("0.12"), "StockOptionLevel", "=", 0),
    (Decimal("0.10"), "WorkLifeBalance", "<=", 2),
    (Decimal("0.10"), "EnvironmentSatisfaction", "<=", 2),
    (Decimal("0.08"), "NumCompaniesWorked", ">=", 5),
    (Decimal("0.07"), "performance_score", "<", 3),
]
PROXY_HIGH = Decimal("0.60")
PROXY_MEDIUM = Decimal("0.35")
PROXY_HIGH_LABEL = "High risk"
PROXY_MEDIUM_LABEL = "Medium risk"
PROXY_LOW_LABEL = "Low risk"
TRUE_POSITIVE = "True positive"
FALSE_POSITIVE = "False positive"
FALSE_NEGATIVE = "False negative"
TRUE_NEGATIVE = "True negative"
PREDICTED_YES = "Predicted: Yes"
PREDICTED_NO = "Predicted: No"

# Q14 text bar: one block per full ten employees.
BAR_BLOCK = "█"
BAR_UNIT = 10
# ------------------------------------------------------------ end fixed values
