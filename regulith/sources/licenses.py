"""Built-in licence requirements and sample provisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "license_key string, state string, license_type string, training_hours int, experience_days int, processing_days int, "
    "application_fee double, exam_fee double, license_fee double, renewal_fee double, exam_required boolean, in_person_required boolean, "
    "notarization_required boolean, background_check boolean, renewal_years int, ce_hours_per_cycle int, recent_reforms string, burden_score int, input_ord int"
)

# Requirements by licence and state, in their order.
LICENSES = (
    ("cosmetology", "California", "Cosmetology", 1600, 0, 45, 50.0, 125.0, 50.0, 50.0, True, True, False, False, 2, 0, None, 7),
    ("cosmetology", "Texas", "Cosmetology", 1500, 0, 30, 50.0, 71.0, 50.0, 62.0, True, False, False, True, 2, 4, "2023: Reduced training hours from 1500 to 1000 for certain specialties", 5),
    ("cosmetology", "Florida", "Cosmetology", 1200, 0, 14, 75.0, 63.0, 0.0, 64.0, True, False, False, False, 2, 16, "2020: SB 474 reduced hours from 1200 to 1000 for hair specialists", 4),
    ("cosmetology", "New York", "Cosmetology", 1000, 0, 60, 40.0, 15.0, 40.0, 40.0, True, True, False, False, 4, 0, None, 5),
    ("cosmetology", "Colorado", "Cosmetology", 1800, 0, 21, 35.0, 105.0, 0.0, 65.0, True, False, False, False, 2, 0, None, 6),
    ("cosmetology", "Arizona", "Cosmetology", 1600, 0, 10, 50.0, 75.0, 0.0, 45.0, True, False, False, False, 2, 0, "2019: Universal license recognition for out-of-state practitioners", 5),
    ("contractor", "California", "General Contractor", 0, 1460, 90, 450.0, 150.0, 200.0, 450.0, True, True, True, True, 2, 0, None, 8),
    ("contractor", "Texas", "General Contractor", 0, 0, 0, 0.0, 0.0, 0.0, 0.0, False, False, False, False, 0, 0, "Texas does not require a state general contractor license", 1),
    ("contractor", "Florida", "General Contractor", 0, 1460, 30, 249.0, 199.0, 100.0, 209.0, True, False, False, True, 2, 14, None, 6),
    ("real_estate", "California", "Real Estate Agent", 135, 0, 45, 60.0, 60.0, 245.0, 245.0, True, True, False, True, 4, 45, None, 6),
    ("real_estate", "Texas", "Real Estate Agent", 180, 0, 30, 205.0, 54.0, 0.0, 110.0, True, False, False, True, 2, 18, None, 5),
    ("real_estate", "Florida", "Real Estate Agent", 63, 0, 14, 83.0, 57.0, 0.0, 64.0, True, False, False, True, 2, 14, "2021: Streamlined online application process", 3),
)

# Sample provisions by "state licence type".
SAMPLE_STATUTES = {
    "California Cosmetology": """
California Business and Professions Code Section 7316

(a) An applicant for a license to practice cosmetology shall:
    (1) Be at least 17 years of age
    (2) Have completed the 10th grade in school or its equivalent
    (3) Have completed a course in cosmetology from a school approved by the board
        consisting of not less than 1,600 hours of training
    (4) Pass an examination conducted by the board

(b) The examination shall consist of both a written test and a practical demonstration.
    The practical examination shall be conducted in person at a board-approved location.

(c) Application fee: $50
    Initial license fee: $50
    Examination fee: $125
""",
    "Florida Cosmetology (Reformed)": """
Florida Statutes Section 477.019 - Licensure

(1) The department shall license as a cosmetologist any applicant who:
    (a) Is at least 16 years of age or has received a high school diploma
    (b) Has completed a minimum of 1,200 hours of training, OR has completed
        1,000 hours for hair-only specialization (as amended by SB 474)
    (c) Has passed the required examination

(2) STREAMLINED PROCESS:
    (a) Applications may be submitted electronically
    (b) The department shall process complete applications within 14 business days
    (c) Examination results shall be provided within 48 hours

(3) FEES: A single consolidated fee of $138 covers application, examination,
    and initial licensure. Fees are refundable if application is denied.
""",
    "Arizona Universal Recognition": """
Arizona Revised Statutes Section 32-4302 - Universal License Recognition

A. Notwithstanding any other law, an individual who establishes residence
   in this state may engage in any occupation for which the individual
   holds a current license in good standing from another state, if:

   1. The license is for the same occupation and scope of practice
   2. The individual worked in that occupation for at least one year
   3. The individual has not had a license revoked in any jurisdiction
   4. The individual has no pending complaints or investigations

B. The individual shall register with the relevant Arizona board within
   30 days of beginning work, paying only the registration fee.

C. The board shall not impose additional training, examination, or
   waiting period requirements beyond those in subsection A.
""",
    "Texas No License (Contractor)": """
Texas does not require a state-level general contractor license.

Local jurisdictions may require registration or permits for specific projects,
but there is no statewide licensing requirement, examination, or training mandate.

Contractors must:
- Obtain necessary building permits for specific projects
- Comply with local building codes
- Carry appropriate insurance (recommended but not mandated)

This approach prioritizes market-based accountability over regulatory barriers.
""",
}


def licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*row, i) for i, row in enumerate(LICENSES)], SCHEMA)


def sample_statutes(spark: SparkSession) -> DataFrame:
    """name, text"""
    return spark.createDataFrame(list(SAMPLE_STATUTES.items()), "name string, text string")
