"""Documents with regulatory wording: each document's whole text between two clauses.

The driver's prose is invented, so rules hardly match it. Clauses are chosen by the document's id and
cover every rule; near misses are among them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLAUSES = (
    "Section 12.4 Filing\nEvery form shall be signed by the owner, shall sign in duplicate, and bears the signature of the holder. An original signature is needed; the owner must personally sign, hand-signed and signed in ink, with a wet signature or physical signature.",
    "Article IV Notaries\nThe deed shall be notarized and acknowledged before a notary, with a notarial seal or notarial certificate of a notary public. It must be sworn before an officer. Penalty applies to any violation.",
    "Chapter 7 Attendance\nThe applicant shall appear in person, or shall appear before the board; personal appearance is mandatory. The applicant is physically present, may appear before an examiner, or appear at the office or appear at a hearing in-person.",
    "Part B Reports\nThe holder shall submit a report, shall file an annual report and shall provide quarterly report data. Each reporting requirement and report requirement stands; the clerk shall report to the agency and is required to report. A quarterly report and a monthly report follow.",
    "Sec. 3 Waiting\nNot less than 30 days pass, at least 2 weeks or no fewer than 3 months; a waiting period of 10 days applies, 15 days before the hearing and 20 day after it. A cooling-off period or cooling off period of 5 days following notice is not fewer than 5.",
    "Notice shall be published in the gazette and the board shall publish in the register. Publication in a newspaper is required, and the clerk shall be published for review.",
    "§ 9 Hearings\nA public hearing shall be held with opportunity for a hearing and opportunity for hearing before the council. A felony voids the licence, and an invalid form is void.",
    "Approval of the director is needed, approval from the board and approval by commissioner, with the consent of all, subject to the approval of staff. Approval of the plan and the budget by the agency requires them to coordinate with others in consultation with the local department.",
    "A filing fee of $25 and an application fee of $1,250.00 are due; a fee not to exceed $40 and fee not exceeding 30, a license fee of $75, and a processing fee. The fee is refundable within 14 days.",
    "Requests are made in writing by written application, written request or written notice, delivered by mail, mailed to the clerk, mail to the board, by certified mail or by registered mail with written consent.",
    "The code as it existed on January 1, 1999 and as existed on March 15, 2004 applies, prior to June 30, 2010 and prior to December 31, 1988.",
    "Notwithstanding any other provision, and notwithstanding any law or this section, except as otherwise provided and except as provided here, in the event of a conflict or in the event of conflict with this part, in conflict with rules.",
    "Fees are reasonable, notice is adequate and cause sufficient, as the director deems necessary or as an officer determines appropriate for good cause.",
    "Herein, hereof, hereby, hereto, hereafter and heretofore: thereof, therein, thereto, whereof, wherein, whereas, aforementioned and aforesaid, notwithstanding the above, pursuant to rules, in accordance with law and with respect to all.",
    "In the event that rain falls, for the purpose of safety, in order to help, prior to work and subsequent to it, at such time as needed, in the amount of ten, by means of tools, by virtue of office and due to the fact that rules bind.",
    "In lieu of cash, with regard to time, it is necessary that staff act. The clerk is authorized to act, is required to sign and is entitled to leave; the form shall be kept, shall not be lost and shall have a number. It shall be required to be filed.",
    'Section 8.1 Terms\nSee section . for details and refer to section 5.1(a), as defined in section 2 or under § 8. "Agency" means the state board. "Form" means any paper. "agency" means the local office.\nIt is 42 U.S.C. 1983 (b) and 17 C.F.R. 240 by law.',
    "Online and electronic forms may be used; electronically filed papers are digital. The board may waive a fee, a waiver is online, and waive(d) rules are avoided. Notarized copies within 30 days, within 1 year or 6 months, are required in person at a public hearing.",
    "The counterpart of the form is avoided. Billions are billed yearly, fees and coffee; paragraphs (a), (b) and (c) were amended, are filed and is to be filed; fees were to be reviewed by whoever had been named.",
    "This Administrative Code and the Admin. Code follow the Code of Federal Regulations.",
    "An Executive Order of the governor sets policy and guidance.",
    "United States Code; be it enacted by the people that the permit must be sought by mail.",
    "An unusually long requirement follows in which the holder of the permit that was issued by the office shall keep every record of each and every visit to every site that was inspected in the year before the year in which the permit is renewed by the office of the board. Short one!",
    "Plain words only. Nothing to see here.",
)


def corpus(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, source, text: the whole document between two clauses."""
    clauses = F.array(*map(F.lit, CLAUSES))
    pick = lambda i: F.element_at(clauses, (F.pmod(i, F.lit(len(CLAUSES))) + 1).cast("int"))
    return docs.select("doc_id", "source", F.concat_ws("\n", pick(F.col("doc_id")), F.coalesce("text", F.lit("")), pick(7 * F.col("doc_id") + 3)).alias("text"))
